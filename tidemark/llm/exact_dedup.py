"""Exact dedup: group by a 128-bit content hash and compare bytes inside the groups. DataFrame functions only.

The text goes through one shuffle, after each task has combined its own equal
texts, so that a group of copies of any size reaches a reducer as one row per
task at most. Rows are joined back to their group by the hash, without text, large groups in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LARGE, SPACE, one_row_each, saved, spread_join

BIG = "10000000000000000000"  # 10**19, above any 64-bit id


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=F.md5, large: int = LARGE) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the most code points in its original
    text stays, then the smallest id. hash_of makes the 128-bit content hash; if
    different texts share it, groups are told apart by their bytes.

    Null and empty texts are one group. Rows that repeat an id and a text share
    its decision, since an id names one document here (keep_first keeps one row). Null ids lose to others; a group of null ids
    alone has keep_id null and keeps its rows. An empty table gives no rows.
    Other columns are ignored whatever their names.
    """
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    base = docs.select(doc.alias("doc_id"), normalised(text).alias("norm"), F.char_length(F.coalesce(text, F.lit(""))).alias("length"))
    base = base.withColumn("h", hash_of("norm"))
    # longest first, then smallest id; a decimal is a fixed-width buffer, so the aggregate stays a hash aggregate
    order = F.expr(f"cast(length as decimal(10,0)) * cast('{BIG}' as decimal(20,0)) - cast(doc_id as decimal(20,0))")
    classes = base.withColumn("key", order).groupBy("h", "norm").agg(F.max_by("doc_id", "key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = saved(classes.select("h", "keep_id", "group_size"), "exact-groups")
    collided = not groups.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    rows = base.withColumn("text_sha256", F.sha2("norm", 256))
    if collided:
        out = rows.join(classes, ["h", "norm"])
    else:
        out = spread_join(rows.drop("norm", "length"), groups.withColumn("rows", F.col("group_size")), "h", "rows", "doc_id", large)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with the columns of docs: the longest original text, then the smallest id.

    Rows are judged one by one: of rows that repeat an id and a text one stays, rows of one id with different texts are different rows, and null ids are later
    than all others. Columns may have any names.
    """
    text = F.col("text")
    # longest first, then smallest id, then a hash of the original text; equal keys in a group are repeated rows
    key = F.expr("cast(char_length(coalesce(text, '')) as decimal(10,0)) * cast('1e28' as decimal(29,0))")
    key += F.expr("(cast('9223372036854775808' as decimal(20,0)) - coalesce(cast(cast(doc_id as bigint) as decimal(20,0)), cast('9223372036854775808' as decimal(20,0)))) * cast('1e8' as decimal(9,0))")
    key = (key + F.pmod(F.xxhash64("text"), F.lit(10**8)).cast("decimal(9,0)")).cast("decimal(38,0)")
    base = docs.select(normalised(text).alias("norm"), key.alias("key")).withColumn("h", F.md5("norm"))
    best = saved(base.groupBy("h", "norm").agg(F.max("key").alias("key")).select("h", "key"), "exact-best")
    counts = base.groupBy("h", "key").agg(F.count(F.lit(1)).alias("n"))
    kept = saved(best.join(counts, ["h", "key"]).select("h", "key", "n"), "exact-kept")
    return one_row_each(docs, [F.md5(normalised(text)), key], kept)


ORACLE = r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm, length(coalesce(text, '')) AS len FROM documents),
g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY len DESC, doc_id) AS keep_id FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)"""
