"""SimHash near-dedup with an index of deletion variants.

A fingerprint has 64 bits, and two are linked at up to 4 differing bits. Cut into 3 segments,
one segment of a linked pair differs by at most one bit, as 4 bits over 3 segments leave one with at most 1.
So each fingerprint is filed under its segments with one bit wild, 64 keys in all, and linked
pairs meet by an equality join on a key. A pair meets under many keys; it is told
only under the first one that its difference allows, and only at up to 4 bits. Keys have 20 or 21 bits, so the pairs that meet grow with the
square of the distinct fingerprints, as an exact answer at 4 bits has it; none meets twice under one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved, spread_join
from tidemark.llm.components import components

BITS = 64
CHUNK = 65_536


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of the text's word shingles, repeats included; 0 without words."""
    ws = (text or "").encode().lower().split()  # of bytes: ASCII letters and white space only
    if not ws:
        return 0
    if len(ws) < words:
        return xxhash.xxh64_intdigest(b" ".join(ws), 42)
    joined = b" ".join(ws)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ws) - words + 1
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(at + CHUNK, n)].tolist(), ends[at + words - 1 : min(at + CHUNK, n) + words - 1].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def segments(count: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    cuts = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(first: int, bits: int) -> int:
    m = ((1 << bits) - 1) << first
    return m - (1 << 64) if m >> 63 else m


def variants(count: int) -> Column:
    """For each bit of the fingerprint its segment with that bit wild: array of struct(v = the bit, key)."""
    def variant(first: int, bits: int, wild: int) -> Column:
        rest = _mask(first, bits) & ~_mask(wild, 1)
        return F.struct(F.lit(wild).alias("v"), F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(rest)), first).alias("key"))

    return F.array(*[variant(first, bits, w) for first, bits in segments(count) for w in range(first, first + bits)])


def told_at(x: Column, count: int) -> Column:
    """The variant under which a pair with the difference x is told: in the first segment with at most one differing bit, that bit, or the segment's first."""
    out = F.lit(-1)
    for first, bits in reversed(segments(count)):
        d = x.bitwiseAND(F.lit(_mask(first, bits)))
        n = F.bit_count(d)
        # bits below the single one
        out = F.when(n == 0, first).when(n == 1, F.when(d < 0, 63).otherwise(F.bit_count(d - F.when(d < 0, 0).otherwise(1)))).otherwise(out)
    return out


def links(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at up to `distance` differing bits, each once. nodes: fp.

    Spark takes the keys to be no larger than the nodes they are made of, 64 times too small, and would send them to the driver for broadcast; so the join is told to sort.
    """
    count = (distance + 2) // 2  # the fewest segments of which one differs by at most one bit
    keys = nodes.select("fp", F.inline(variants(count)))
    a, b = keys.alias("a"), keys.alias("b")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    on = (F.col("a.v") == F.col("b.v")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= distance) & (told_at(x, count) == F.col("a.v"))
    return a.join(b.hint("merge"), on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex), component_id (the smallest doc_id reachable over links).

    Rows of one fingerprint are one node. Null and empty texts have fingerprint zero, which links like any other.
    Null ids are never the smallest; a component of null ids alone has component_id null. Repeated rows repeat. An empty table gives no rows;
    columns other than doc_id and text are ignored.
    """
    prints = saved(fingerprints(docs, words), "fingerprints")
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-nodes")
    joined = components(links(nodes.select("fp"), distance))
    of = nodes.join(joined.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = saved(of.join(least, "component").select("fp", "component_id", "rows"), "simhash-components")
    return spread_join(prints, named, "fp", "rows", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
