"""Fill-in-the-middle transformation by one counted regular expression a row (operator 11).

1. ``regexp_count`` gives the number n of units of a text (a run of letters, or
   any other code point).  It counts blocks of ``COUNT_BLOCK`` units first and the
   rest unit by unit, so its array of matches holds a text once and few strings.
2. Two hashes of the id name two cuts among the n + 1 places.
3. A pattern of the row's own, ``(unit{a})(unit{b-a})(rest)`` with possessive
   quantifiers, captures prefix, middle and suffix; the replacement writes them
   in the order of the row's form.  Possessive groups are matched in a loop, not by
   recursion, so the length of a text is bounded by memory alone.

Everything is a column expression: no shuffle, no Python on executors.  No part of
a text holds a marker, and no marker overlaps another, so the output can be taken
apart without doubt.

Defined results: a null or empty text is ``plain`` with an empty output and n = 0;
a text that holds a marker is ``plain``; a null id is hashed as an empty one;
repeated rows are each transformed, alike; an empty table gives no rows; other
columns of the input play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = "(?:[A-Za-z]++|[^A-Za-z])"
#: Units of a block that is counted as one match.
COUNT_BLOCK = 64


def unit_count(text: Column) -> Column:
    """Number of units of a text; ``\\G`` keeps the search from starting again inside a block."""
    block = f"\\G{UNIT}{{{COUNT_BLOCK}}}+"
    return (F.regexp_count(text, F.lit(block)) * COUNT_BLOCK
            + F.regexp_count(F.regexp_replace(text, block, ""), F.lit(UNIT))).cast("long")


def hashes(id_col: Column, seed: str) -> list[Column]:
    """The first four groups of eight hex digits of sha256(seed:id) as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of."""
    psm = F.regexp_replace(output, f"(?s)\\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\\z", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)\\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\\z", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "1",
                   plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs``.

    ``plain_percent`` of the rows keep their text; of the others ``spm_percent``
    begin with the suffix and the rest with the prefix.
    """
    h1, h2, h3, h4 = hashes(F.col(id_col), seed)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), body.alias("body"), unit_count(body).alias("n"), h1.alias("h1"), h2.alias("h2"),
        F.when((body == "") | marked | (h3 % 100 >= 100 - plain_percent), "plain")
        .when(h4 % 100 < spm_percent, "spm").otherwise("psm").alias("form"))
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    pattern = F.concat(F.lit(f"(?s)\\A({UNIT}{{"), F.least(x, y).cast("string"), F.lit(f"}}+)({UNIT}{{"),
                       F.abs(x - y).cast("string"), F.lit("}+)(.*)\\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    out = rows.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("body")).otherwise(
        F.regexp_replace(F.col("body"), pattern, order)).alias("output"))
    at = lambda marker: F.instr("output", marker)
    width = len(PREFIX)
    return out.select(
        "doc_id", "n", "form",
        F.when(F.col("form") == "psm", at(SUFFIX) - 1 - width).when(F.col("form") == "spm", at(MIDDLE) - at(PREFIX) - width)
        .cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.length("output") - at(MIDDLE) + 1 - width).cast("long").alias("middle_chars"),
        "output")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document cut in three, with digests of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, body, u, len(u)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
             ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, body, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, body, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
             array_to_string(u[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                   ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN body ELSE pre || mid || suf END) AS restored_sha256
FROM p"""
