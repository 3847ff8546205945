"""Benchmark decontamination (operator 7): multi-pattern search by block shifts.

Test strings are windows of ten consecutive words of a benchmark item (the
whole item if it has fewer).  They are sought in every whole document with the
tables of Wu and Manber (1994), over words instead of bytes:

* a shift table over blocks of two words tells how far the window must move
  on; only positions with shift 0, the end of some test string, are looked at;
* a table from the hash of the last block (suffix) selects the test strings
  that may end there, the hash of the whole window narrows them;
* the words themselves are compared before a hit counts.

The shift test runs for a whole batch of documents at once.
Test strings are compiled in blocks of bounded size; each block is broadcast
and searched in all documents in its own pass, so any number of items works.

Defined results: a null text has no words; an empty document or benchmark
table gives no hits; rows with a null item id take no part (they have no name
to report); repeated items and rows are all reported; columns of the input are
carried along unchanged, result columns are suffixed if they clash.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import table, written
from wayline.llm.textcode import ALNUM_WORDS, Words, chunks, mix, ngrams

WINDOW = 10
#: Characters of benchmark text compiled into one block of test strings (what a pass broadcasts).
BLOCK_CHARS = 4 << 20
_SHIFT_BITS = 18


class PatternGroup:
    """Test strings of one length ``m`` with their shift and suffix tables."""

    def __init__(self, m: int, strings: dict[tuple[bytes, ...], list[str]]):
        self.m, self.block = m, min(2, m)
        self.strings = list(strings)
        self.items = [sorted(set(strings[s])) for s in self.strings]
        flat = pa.array([" ".join(x.decode("utf-8") for x in s) for s in self.strings], type=pa.large_string())
        w = Words(flat, ALNUM_WORDS, True)
        h = w.hashes()
        self.shift = np.full(1 << _SHIFT_BITS, m - self.block + 1, dtype=np.int32)
        blocks = ngrams(h, self.block)
        rows = w.offs[:-1]
        for j in range(m - self.block + 1):  # block of words j.., its end is m - block - j words before the end
            np.minimum.at(self.shift, _slot(blocks[rows + j]), m - self.block - j)
        suffix, whole = blocks[rows + m - self.block], ngrams(h, m)[rows]
        order = np.lexsort((whole, suffix))
        self.suffix, self.whole, self.which = suffix[order], whole[order], order
        self.suffixes, at = np.unique(self.suffix, return_index=True)
        self.bucket = {int(s): (int(a), int(b)) for s, a, b in zip(self.suffixes, at, [*at[1:], len(order)])}

    def find(self, w: Words, h: np.ndarray) -> list[tuple[int, int]]:
        """(first word, index of the test string) of every occurrence."""
        m = self.m
        if len(h) < m:
            return []
        block = ngrams(h, self.block)
        start = w.room(m)
        suffix = block[start + m - self.block]
        start = start[self.shift[_slot(suffix)] == 0]  # all other positions are skipped
        if not len(start):
            return []
        suffix = block[start + m - self.block]
        known = np.isin(suffix, self.suffixes)
        start, suffix = start[known], suffix[known]
        out = []
        whole = np.zeros(len(start), dtype=np.uint64)
        p = np.uint64(1)
        with np.errstate(over="ignore"):
            for j in range(m):
                whole += h[start + j] * p
                p *= np.uint64(0xD6E8FEB86659FD93)
        whole = mix(whole)
        for s, x, y in zip(start.tolist(), suffix.tolist(), whole.tolist()):
            lo, hi = self.bucket[x]
            k = lo + int(np.searchsorted(self.whole[lo:hi], np.uint64(y)))
            while k < hi and int(self.whole[k]) == y:
                if w.span(s, s + m) == self.strings[self.which[k]]:
                    out.append((s, int(self.which[k])))
                k += 1
        return out


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - _SHIFT_BITS)).astype(np.int64)


def compile_items(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[PatternGroup]:
    """Test strings of (item id, text) pairs, grouped by their number of words."""
    by_len: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
    for name, text in items:
        w = Words(pa.array([text], type=pa.large_string()), ALNUM_WORDS, True)
        n = len(w.start)
        words = w.span(0, n)
        for i in range(max(1, n - window + 1) if n else 0):
            s = words[i:i + window]
            by_len[len(s)][s].append(name)
    return [PatternGroup(m, dict(s)) for m, s in sorted(by_len.items())]


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
               item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with n_words, hit_words (indices of hit words), items (sorted names), contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = int(chars // block_chars) + 1
    items = items.withColumn("b", F.pmod(F.xxhash64("i"), F.lit(blocks)))
    taken = list(docs.columns)
    names = [_free(n, taken) for n in ("n_words", "hit_words", "items", "contaminated")]
    out = docs
    for b in range(blocks):
        # at most about block_chars characters (checked above; an item is never split)
        part = [(r.i, r.t) for r in items.where(F.col("b") == b).select("i", "t").toLocalIterator()]
        groups = spark.sparkContext.broadcast(compile_items(part, window))
        out = _search(out, text, names, groups, first=b == 0)
        if b + 1 < blocks:
            out = written(out, "leaks")
    return out.withColumn(names[3], F.size(names[1]) > 0)


def _search(docs: DataFrame, text: str, names: list[str], groups, first: bool) -> DataFrame:
    n_words, hit_words, items, _ = names
    schema = T.StructType([*docs.schema.fields])
    if first:
        schema = (schema.add(n_words, T.LongType()).add(hit_words, T.ArrayType(T.IntegerType()))
                  .add(items, T.ArrayType(T.StringType())))

    def search(batches):
        found = groups.value
        for batch in batches:
            for part in chunks(batch, text):
                yield _search_part(part, text, names, found)

    return docs.mapInArrow(search, schema)


def _search_part(part: pa.RecordBatch, text: str, names: list[str], groups: list[PatternGroup]) -> pa.RecordBatch:
    n_words, hit_words, items, _ = names
    w = Words(part.column(part.schema.get_field_index(text)), ALNUM_WORDS, True)
    h = w.hashes()
    hit: dict[int, set[int]] = defaultdict(set)
    named: dict[int, set[str]] = defaultdict(set)
    for g in groups:
        for s, k in g.find(w, h):
            d = int(np.searchsorted(w.offs, s, side="right")) - 1
            hit[d].update(range(s - int(w.offs[d]), s - int(w.offs[d]) + g.m))
            named[d].update(g.items[k])
    cols, fields = list(part.columns), list(part.schema.names)
    if n_words in fields:  # a later block of test strings: add to what is there
        for d, (a, b) in enumerate(zip(part.column(fields.index(hit_words)).to_pylist(),
                                       part.column(fields.index(items)).to_pylist())):
            if a:
                hit[d].update(a)
                named[d].update(b)
        keep = [i for i, f in enumerate(fields) if f not in (n_words, hit_words, items)]
        cols, fields = [cols[i] for i in keep], [fields[i] for i in keep]
    n = part.num_rows
    cols += [pa.array(w.counts, type=pa.int64()),
             pa.array([sorted(hit[d]) if d in hit else [] for d in range(n)], type=pa.list_(pa.int32())),
             pa.array([sorted(named[d]) if d in named else [] for d in range(n)], type=pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(cols, names=[*fields, n_words, hit_words, items])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every whole document against the whole benchmark table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract by plain loops (for tests): (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re
    rule = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = {i: i + 32 for i in range(0x41, 0x5B)}
    cut = lambda t: rule.findall((t or "").translate(lower))
    strings = defaultdict(set)
    for name, text in items:
        w = cut(text)
        if w and name is not None:
            for i in range(max(1, len(w) - window + 1)):
                strings[tuple(w[i:i + window])].add(str(name))
    out = []
    for doc_id, text in docs:
        w, hit, named = cut(text), set(), set()
        for m in {len(s) for s in strings}:
            for i in range(len(w) - m + 1):
                if (x := tuple(w[i:i + m])) in strings:
                    hit.update(range(i, i + m))
                    named |= strings[x]
        out.append((doc_id, len(w), len(hit), len(named),
                    hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return out
