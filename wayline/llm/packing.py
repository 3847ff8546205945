"""Packing token sequences by a linear grouping scheme and best fit (operator 8).

1. Documents are tokenised whole and end with one end token.  Longer ones than
   ``size`` are cut so that all pieces but the first are full; full pieces are
   sequences of their own.
2. What remains is a histogram: the number of pieces of each length below
   ``size``.  It has at most ``size`` rows, whatever the number of documents, and
   is all that reaches the driver.
3. Large pieces (over ``size / small``) are sorted and put into ``groups`` groups of equal
   cardinality; every length is rounded up to the largest of its group.
4. Configurations of rounded lengths are optimised one after another: the
   fullest set of remaining lengths that holds the largest one, by dynamic
   programming, used as often as the counts allow.
5. Actual pieces take the places of their group, which leaves slack; small
   pieces then go, longest first, where they fit best, and open new sequences
   only when nothing fits.
6. The plan is a table of ranges (length, first rank, last rank -> sequence,
   offset) with a few rows for each length and configuration.  Every piece finds
   its place by its rank among the pieces of its length; ranks come from counts
   per (length, slice) plus a window inside the slice, so a length that a third
   of all pieces share is never ranked by one task.

Defined results: a null text counts as empty and gives one piece with the end
token; repeated rows are packed each; rows with a null id are packed too; an empty
table gives no rows; other columns play no part.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wayline.llm.common import table, written
from wayline.llm.textcode import buffer_of, chunks, hash_spans

SIZE = 2048
END = 0
GROUPS = 128
#: Pieces up to size / SMALL are small.
SMALL = 8
#: Slices of a length that are ranked apart.
SLICES = 64
#: Different pre-tokens whose ids a worker keeps.
CACHE = 400_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache
def _kinds() -> np.ndarray:
    """Kind of each code point in the vocabulary's split: 0 white space, 1 letter, 2 number, 3 any other."""
    import regex
    out = np.full(0x110000, 3, dtype=np.uint8)
    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, rule in enumerate((r"\s", r"\p{L}", r"\p{N}")):
        out[np.frombuffer("".join(regex.findall(rule, whole)).encode("utf-32-le"), dtype="<u4")] = kind
    return out


def split(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of the pre-tokens of UTF-8 texts that lie end to end in ``buf`` (text i begins at ``offs[i]``).

    The split is ``public_tokenizers.PATTERN``: contractions; runs of letters, of
    numbers or of others, each with one space before it; white space, whose last
    character stands alone before a word.
    """
    if not len(buf):
        return np.zeros(0, dtype=np.int64)
    code = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    at = np.flatnonzero((buf & 0xC0) != 0x80)  # first byte of each character
    kind = _kinds()[code]
    n = len(code)
    text = np.zeros(n + 1, dtype=bool)
    text[np.searchsorted(at, offs)] = True
    text[n] = True
    run = text.copy()  # where a run of one kind begins
    run[1:n] |= kind[1:] != kind[:-1]
    white = kind == 0
    after_space = np.zeros(n, dtype=bool)
    after_space[1:] = (code[:-1] == 0x20) & ~text[1:n]
    first = run[:n] & (white | ~after_space)
    first |= white & run[1:] & ~text[1:]  # the last white space before a word
    quote = np.flatnonzero((code == 0x27) & run[:n] & run[1:] & ~after_space & ~text[1:])
    if len(quote):
        end = np.append(code, np.zeros(2, dtype=code.dtype))
        same = np.append(~run[1:], False)  # the next character goes on with the same run
        one, two = end[quote + 1], end[quote + 2]
        short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
        long = (((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)) & same[quote + 1]
        for hit, size in ((quote[short], 1), (quote[long], 2)):
            first[hit + 1] = False
            rest = hit + 1 + size
            first[rest[rest < n]] = True
    return at[first]


class WordEncoder:
    """Ids by ``tokenizers``: each different pre-token is encoded once, all others are looked up by a 64-bit hash.

    Two of a worker's words share a hash with probability below 1e-8.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok, self.whole = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # the split never cuts at their names
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.keys, self.row = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # by hash
        self.ids, self.first = np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)  # ids of all rows; where each begins

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        ids = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        rows = np.arange(len(ids)) + len(self.first) - 1
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4", count=int(n.sum()))])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.row = np.insert(self.keys, place, keys), np.insert(self.row, place, rows)

    def encode(self, col: pa.Array) -> list[np.ndarray]:
        """Ids of each text; one that holds the name of an added token is encoded as a whole."""
        out = self._by_word(col)
        special = np.zeros(len(col), dtype=bool)
        for name in self.added:
            special |= pc.match_substring(col.cast(pa.large_string()), name).fill_null(False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(special).tolist():
            out[i] = np.array(self.whole.encode(col[i].as_py(), add_special_tokens=False).ids, dtype="<u4")
        return out

    def _by_word(self, col: pa.Array) -> list[np.ndarray]:
        buf, offs = buffer_of(col)
        start = split(buf, offs[:-1][np.diff(offs) > 0])
        if not len(start):
            return [np.zeros(0, dtype="<u4")] * len(col)
        size = np.diff(np.append(start, len(buf)))
        keys, at, word = np.unique(hash_spans(buf, start, size), return_index=True, return_inverse=True)
        if len(self.keys) > CACHE:
            self.clear()
        new = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
        if len(new):
            data = buf.tobytes()
            self._learn(keys[new], [data[i:i + n].decode() for i, n in zip(start[at[new]].tolist(), size[at[new]].tolist())])
        row = self.row[np.searchsorted(self.keys, keys)][word]
        count = self.first[row + 1] - self.first[row]
        upto = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.first[row] - upto[:-1], count) + np.arange(upto[-1])]
        cut = upto[np.searchsorted(start, offs)]
        return [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process: later tasks find the words of earlier ones."""
    return WordEncoder(path)


def pieces(docs: DataFrame, id_col: str, text: str, vocabulary: str, size: int) -> DataFrame:
    """One row for each piece of each document."""
    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import public_tokenizers as P
        words = encoder(P.path(vocabulary))
        for batch in batches:
            for part in chunks(batch, "text"):
                ids = part.column(0).to_pylist()
                rows = []
                for d, seq in zip(ids, words.encode(part.column(1))):
                    seq = np.append(seq, np.uint32(END)).astype("<u4")
                    n = len(seq)
                    cuts = [0, *range(n % size or size, n, size), n]
                    rows += [(d, i, a, b - a, zlib.crc32(seq[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), r)) for r in rows],
                    schema=pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                                      ("length", pa.int64()), ("ids_crc32", pa.int64())]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECES)


def _fill(sizes: list[int], counts: dict[int, int], size: int) -> list[int]:
    """The fullest set of remaining sizes that holds the largest one; ties go to larger sizes."""
    largest = sizes[0]
    room = size - largest
    reach = np.full(room + 1, -1, dtype=np.int64)  # size put in last to reach this sum
    reach[0] = 0
    for s in sizes:
        if s > room:
            continue
        for _ in range(min(counts[s] - (s == largest), room // s)):
            old = np.flatnonzero(reach >= 0)
            old = old[old + s <= room]
            new = old[(reach[old + s] < 0)] + s
            if not len(new):
                break
            reach[new] = s
    total = int(np.flatnonzero(reach >= 0)[-1])
    out = [largest]
    while total:
        out.append(int(reach[total]))
        total -= int(reach[total])
    return out


def plan(histogram: dict[int, int], size: int = SIZE, groups: int = GROUPS, small: int = SMALL) -> list[tuple[int, int, int, int, int]]:
    """Ranges (length, first rank, last rank, sequence of the first, offset) for a histogram of lengths below ``size``.

    Rank r of a length goes to sequence ``first sequence + (r - first rank)``.
    """
    large = sorted((x for x in histogram if x * small > size), reverse=True)
    total = sum(histogram[x] for x in large)
    # equal-cardinality groups over the sorted pieces, as lists of (length, first rank, number)
    step = max(1, -(-total // groups))
    group_of: dict[int, list[list[int]]] = defaultdict(list)
    at, top = 0, 0
    for x in large:
        rank = 0
        while rank < histogram[x]:
            if at % step == 0:
                top = x
            n = min(step - at % step, histogram[x] - rank)
            group_of[top].append([x, rank, n])
            rank, at = rank + n, at + n
    counts = {g: sum(n for _, _, n in v) for g, v in group_of.items()}
    out: list[tuple[int, int, int, int, int]] = []
    space: dict[int, list[list[int]]] = defaultdict(list)  # room left -> [first sequence, number]
    sequences = 0
    # configurations of rounded sizes, each used as often as the counts allow
    while counts:
        sizes = sorted(counts, reverse=True)
        config = _fill(sizes, counts, size)
        used = Counter(config)
        times = min(counts[g] // n for g, n in used.items())
        for g, n in used.items():
            counts[g] -= n * times
            if not counts[g]:
                del counts[g]
        # actual pieces take the places: runs of copies whose pieces have equal lengths
        done = 0
        pools = []
        for g in config:
            take, pool = times, []
            while take:
                x, rank, n = group_of[g][0]
                k = min(n, take)
                pool.append([x, rank, k])
                if k == n:
                    group_of[g].pop(0)
                else:
                    group_of[g][0] = [x, rank + k, n - k]
                take -= k
            pools.append(pool)
        while done < times:
            k = min(p[0][2] for p in pools)
            offset = 0
            for p in pools:
                x, rank, n = p[0]
                out.append((x, rank, rank + k - 1, sequences + done, offset))
                offset += x
                p[0] = [x, rank + k, n - k]
                if n == k:
                    p.pop(0)
            space[size - offset].append([sequences + done, k])
            done += k
        sequences += times
    # small pieces, longest first, where they fit best
    rooms = sorted(r for r in space if r > 0)
    for x in sorted((x for x in histogram if x * small <= size), reverse=True):
        rank, left = 0, histogram[x]
        while left:
            i = bisect.bisect_left(rooms, x)
            if i == len(rooms):  # nothing fits: open the sequences that the rest of this length fills
                k = -(-left // (size // x))
                space[size] = [[sequences, k]]
                bisect.insort(rooms, size)
                sequences += k
                continue
            room = rooms[i]
            first, n = space[room][-1]
            k = min(n, left)
            out.append((x, rank, rank + k - 1, first, size - room))
            rank, left = rank + k, left - k
            if k == n:
                space[room].pop()
                if not space[room]:
                    rooms.pop(i)
            else:
                space[room][-1] = [first + k, n - k]
            if room - x > 0:
                if not space[room - x]:
                    bisect.insort(rooms, room - x)
                space[room - x].append([first, k])
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json",
         size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = written(pieces(docs, id_col, text, vocabulary, size), "pieces")
    # at most size - 1 rows reach the driver
    histogram = {r.length: r.n for r in cut.where(F.col("length") < size).groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranges = plan(histogram, size)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("length", "lo", "hi", "first", "offset")])
    by_length = (spark.createDataFrame(ranges, schema).groupBy("length")
                 .agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "offset"))).alias("ranges")))
    numbered = cut.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SLICES)).cast("int"))
    before = numbered.groupBy("length", "slice").agg(F.count("*").alias("n")).withColumn(  # at most SLICES rows a length
        "before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    ranked = (numbered.withColumn("own", F.row_number().over(
        W.partitionBy("length", "slice").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1)
        .join(F.broadcast(before.select("length", "slice", "before")), ["length", "slice"])  # size * SLICES rows at most
        .withColumn("rank", F.col("own") + F.col("before")))
    # the plan has a few rows for each length and configuration, whatever the number of documents
    placed = ranked.join(F.broadcast(by_length), "length", "left").withColumn(
        "at", F.element_at(F.filter("ranges", lambda r: (r.lo <= F.col("rank")) & (F.col("rank") <= r.hi)), 1))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(F.col("length") == size, -1 - F.col("rank")).otherwise(F.col("at.first") + F.col("rank") - F.col("at.lo")).alias("sequence_id"),
        F.when(F.col("length") == size, F.lit(0)).otherwise(F.col("at.offset")).cast("long").alias("offset"))


def op8_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document, tokenised and packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
