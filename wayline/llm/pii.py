"""Personal data by weak supervision (operator 6), in DataFrame functions alone.

Four kinds are sought: email, ip, card, phone.  A base rule (pattern plus check)
gives spans that always stay.  Candidates are the base matches, the matches that
fail their check, and looser forms (spelled-out addresses, numbers without a
country code).  Three labelers vote +1, -1 or 0 on each candidate:

* regex: the strict pattern and its check (Luhn, octets, digit counts);
* gazetteer: known top-level domains, issuer prefixes, calling codes, networks;
* context: telling words shortly before the span.

Expectation-maximisation over the counts of vote patterns (at most
4 kinds x 27 patterns, the only data that reaches the driver) estimates how
reliable each labeler is; its posterior labels train a final naive Bayes
classifier over votes and shape, whose score decides about candidates that are
not base spans.

Patterns are written so that Java's matcher neither recurses nor restarts inside
a run it has already refused: cost is linear in the text.  Positions are code
points, got from the lengths of the matches and of the pieces between them.

Defined results: a null text counts as empty and has no spans; every row gives
one row, repeated or not; an empty table gives no rows; a null id is returned as
it is; other columns are carried along by ``redact`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import table

KINDS = ("email", "ip", "card", "phone")

#: Base patterns.  (?:\G|(?<!x)) starts a match only where a run begins or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms; they add candidates, never base spans.
LOOSE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Cheap tests that every match passes.
NEEDS = {"email": "@", "phone": "+"}

#: Gazetteers (fixed values).
TOP_LEVEL = r"(?i)[.\x20\])](com|org|net|edu|gov|mil|int|info|io|co|eu|de|fr|es|it|nl|uk|us|ca|ch|at|be|pt|se|no|dk|pl|jp|cn|in|br|au)$"
ISSUER = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CALLING_CODE = r"^\+?\(?(1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58]|[2-9][0-9]{2})"
RESERVED_NET = r"^0*(0|127|22[4-9]|2[3-4][0-9]|25[0-5])\."
CONTEXT = {
    "email": r"(?i)(e-?mail|mail|contact|write|adresse|correo|courriel|kontakt)\W{0,3}\w{0,12}\W{0,3}$",
    "ip": r"(?i)(\bip\b|host|server|address|client|addr)\W{0,3}\w{0,12}\W{0,3}$",
    "card": r"(?i)(card|visa|master|credit|debit|karte|tarjeta|carte|payment)\W{0,3}\w{0,12}\W{0,3}$",
    "phone": r"(?i)(phone|tel|call|mobile|fax|telefon|cell|contact)\W{0,3}\w{0,12}\W{0,3}$",
}
#: Words before the span that speak against it.
COUNTER = r"(?i)(version|order|invoice|token|isbn|id|no|ref|sha|hash)\W{0,4}$"
#: Characters before a span that the context labeler sees.
REACH = 32


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's check of 1 to 19 digits."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + F.when(
        (n - i) % 2 == 1, twice(value(i))).otherwise(value(i)))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        d = _digits(m)
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(F.lit(False))
    return F.length(_digits(m)).between(9, 15)


def _found(text: Column, pattern: str, need: str | None) -> tuple[Column, Column]:
    """(matches, lengths of the pieces between them)."""
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    if need:
        has = F.contains(text, F.lit(need))
        none = F.array().cast("array<string>")
        return F.when(has, match).otherwise(none), F.when(has, gaps).otherwise(F.array().cast("array<int>"))
    return match, gaps


def _placed(match: Column, gaps: Column) -> Column:
    """Matches with their start and end, from the lengths of matches and gaps."""
    step = F.arrays_zip(match.alias("m"), F.slice(gaps, 1, F.size(match)).alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<m:string,s:int,e:int>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(
            x["m"].alias("m"), s.alias("s"), e.alias("e")))).alias("out"))

    return F.aggregate(step, start, add)["out"]


def _votes(kind: str, text: Column, x: Column, strict: Column) -> list[Column]:
    """Votes of the regex, gazetteer and context labelers on a placed match."""
    m = x["m"]
    gazetteer = {
        "email": F.when(m.rlike(TOP_LEVEL), 1).otherwise(0),
        "ip": F.when(m.rlike(RESERVED_NET), -1).otherwise(0),
        "card": F.when(_digits(m).rlike(ISSUER), 1).otherwise(-1),
        "phone": F.when(m.rlike(CALLING_CODE), 1).otherwise(-1),
    }[kind]
    before = F.substring(text, F.greatest(x["s"] - REACH, F.lit(0)) + 1, F.least(x["s"], F.lit(REACH)))
    context = F.when(before.rlike(CONTEXT[kind]), 1).when(before.rlike(COUNTER), -1).otherwise(0)
    return [F.when(strict, 1).otherwise(-1), gazetteer, context]


def _shape(m: Column) -> Column:
    """A small class of shapes: how long the candidate is, and whether it is punctuated."""
    return F.least(F.floor(F.length(m) / 6), F.lit(4)).cast("int") * 2 + m.rlike(r"[\x20()-]").cast("int")


def _voted(kind: str, is_base: bool):
    """A placed match of one form as a candidate with its votes."""
    def vote(x: Column) -> Column:
        strict = _valid(kind, x["m"]) if is_base else F.lit(False)
        v = _votes(kind, F.col("_t"), x, strict)
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), strict.alias("base"),
                        v[0].alias("v1"), v[1].alias("v2"), v[2].alias("v3"), _shape(x["m"]).alias("shape"))
    return vote


CANDIDATE = "array<struct<kind:int,s:int,e:int,base:boolean,v1:int,v2:int,v3:int,shape:int>>"


def candidates(docs: DataFrame, text: str = "text", out: str = "cand") -> DataFrame:
    """``docs`` with an array of voted candidate spans."""
    df = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    forms = [(k, BASE[k], True, NEEDS.get(k)) for k in KINDS] + [(k, p, False, None) for k, p in LOOSE.items()]
    for i, (_, pattern, _, need) in enumerate(forms):
        m, g = _found(F.col("_t"), pattern, need)
        df = df.withColumns({f"_m{i}": m, f"_g{i}": g})
    for i in range(len(forms)):
        df = df.withColumn(f"_p{i}", F.when(F.size(f"_m{i}") > 0, _placed(F.col(f"_m{i}"), F.col(f"_g{i}"))).otherwise(
            F.array().cast("array<struct<m:string,s:int,e:int>>")))
    parts = []
    for i, (kind, _, is_base, _) in enumerate(forms):
        parts.append(F.transform(f"_p{i}", _voted(kind, is_base)).cast(CANDIDATE))
    return df.withColumn(out, F.concat(*parts)).drop("_t", *(f"_{c}{i}" for c in "mgp" for i in range(len(forms))))


def reliabilities(patterns: list[tuple[int, int, int, int, float]], rounds: int = 50) -> dict:
    """EM over (kind, v1, v2, v3, count): posterior of each pattern, and each labeler's accuracy by kind.

    Two classes; a labeler of accuracy a votes rightly with probability a when it
    votes.  The prior of a kind and the accuracies are re-estimated in turn, with
    two pseudo-votes for an accuracy of 0.8.
    """
    kinds = {p[0] for p in patterns}
    prior = dict.fromkeys(kinds, 0.5)
    acc = {(k, j): 0.8 for k in kinds for j in range(3)}
    post = {}
    for _ in range(rounds):
        for k, *v, _ in patterns:
            odds = math.log(prior[k] / (1 - prior[k]))
            for j, x in enumerate(v):
                odds += x * math.log(acc[k, j] / (1 - acc[k, j]))
            post[k, *v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in kinds:
            own = [p for p in patterns if p[0] == k]
            n = sum(p[4] for p in own)
            prior[k] = (1 + sum(post[p[:4]] * p[4] for p in own)) / (2 + n)
            for j in range(3):
                voted = [p for p in own if p[1 + j]]
                right = sum(p[4] * (post[p[:4]] if p[1 + j] > 0 else 1 - post[p[:4]]) for p in voted)
                acc[k, j] = min(0.99, max(0.51, (1.6 + right) / (2 + sum(p[4] for p in voted))))
    return {"posterior": post, "accuracy": acc, "prior": prior}


def classifier(cells: list[tuple], posterior: dict) -> dict:
    """Naive Bayes weights from soft labels: (kind, feature, value) -> log odds, (kind,) -> prior log odds."""
    sums: dict = {}
    for k, v1, v2, v3, shape, n in cells:
        p = posterior[k, v1, v2, v3]
        for key in ((k,), (k, "v1", v1), (k, "v2", v2), (k, "v3", v3), (k, "shape", shape)):
            a = sums.setdefault(key, [0.0, 0.0])
            a[0] += p * n
            a[1] += (1 - p) * n
    out = {}
    for key, (pos, neg) in sums.items():
        if len(key) == 1:
            out[key] = math.log((pos + 1) / (neg + 1))
        else:
            t = sums[key[:1]]
            out[key] = math.log(((pos + 1) / (t[0] + 10)) / ((neg + 1) / (t[1] + 10)))
    return out


def train(cand: DataFrame, column: str = "cand") -> dict:
    """Reliabilities and classifier weights from the votes of a whole table of candidates."""
    c = cand.select(F.explode(column).alias("c")).groupBy("c.kind", "c.v1", "c.v2", "c.v3", "c.shape").agg(F.count("*").alias("n"))
    cells = [tuple(r) for r in c.orderBy("kind", "v1", "v2", "v3", "shape").collect()]  # at most 4 * 27 * 10 rows
    sums: dict = {}
    for *key, _, n in cells:
        sums[tuple(key)] = sums.get(tuple(key), 0) + n
    em = reliabilities([(*k, n) for k, n in sums.items()])
    return {**em, "weights": classifier(cells, em["posterior"])}


def _score(c: Column, weights: dict) -> Column:
    terms = [F.lit(0.0)]
    for key, w in sorted(weights.items(), key=str):
        hit = c["kind"] == key[0]
        if len(key) == 3:
            hit = hit & (c[key[1]] == key[2])
        terms.append(F.when(hit, F.lit(w)).otherwise(F.lit(0.0)))
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms)))


def find_spans(docs: DataFrame, text: str = "text", threshold: float = 0.5, model: dict | None = None) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (s, kind, e) sorted by start, then kind."""
    cand = candidates(docs, text)
    model = model or train(cand)
    span = lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))
    df = cand.withColumn("base", F.array_sort(F.transform(F.filter("cand", lambda c: c["base"]), span)))
    if model["weights"]:
        more = F.filter("cand", lambda c: ~c["base"] & (_score(c, model["weights"]) >= threshold) & ~F.exists(
            "base", lambda b: (b["s"] < c["e"]) & (c["s"] < b["e"])))
        df = df.withColumn("more", F.transform(more, span))
        df = df.withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", "more")))).drop("more")
    else:
        df = df.withColumn("spans", F.col("base"))
    return df.drop("cand")


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), kind + 1)


def _text_of(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _name(x["kind"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans count once."""
    # the input's columns travel in one struct, so none clashes with a work column
    df = find_spans(docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text")))
    t = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(acc: Column, x: Column) -> Column:
        put = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["s"] - acc["at"]),
                                                   F.lit("<"), _name(x["kind"]), F.lit(">"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), put.alias("out"))

    end = F.aggregate("spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
    clean = F.when(F.size("spans") > 0, end).otherwise(t)
    return df.select(*[(clean if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = find_spans(docs)
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return df.select("doc_id", *(n(k) for k in range(4)), F.sha2(_text_of("base").cast("binary"), 256).alias("base_sha256"),
                     _text_of("spans").alias("spans"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """Base spans by Python's re (for tests): (doc_id, n_email, n_ip, n_card, n_phone, base_sha256)."""
    rules = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def ok(kind, m):
        d = [int(c) for c in m if c in "0123456789"]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d)))
            return 12 <= len(d) <= 19 and s % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    out = []
    for doc_id, text in docs:
        spans = [(m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in re.finditer(rules[kind], text or "") if ok(kind, m[0])]
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        out.append((doc_id, *(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
    return out
