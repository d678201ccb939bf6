"""Mixing sources to target weights by pivotal dependent rounding. DataFrame functions only.

Each document gets target / source_size expected copies; its fraction is a probability. Documents are dealt to small
buckets of like size. In a bucket two open documents are paired and probability moves between them at random, so that
expectations hold, until one is integral; the bucket's last open one goes on in a tree of fixed fan-in, until each
class of size has one. Then the classes of a source are folded, larger first: the larger takes the mass of words that it lacks
from the smaller or gives it what it has, at random, and so becomes integral; one that was given more than it
can hold, or owes more than it has, passes the rest on. So the words of a source are kept up to the document that is
left at last and the small differences inside the classes. That holds words, not expectations: where a unit is given more than it can hold
its choice is certain, and the last one of a source is rounded, so expected copies are near the target there, not equal to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, free_names, saved, small

FAN_IN = 64
UNIT = "struct<doc_id: bigint, size: bigint, whole: bigint, p: double>"
DONE = "struct<doc_id: bigint, size: bigint, copies: bigint>"


def targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target. Sources by code point, null last, weigh `weights` in turn and share all words.

    A target stops at `most` times its source; what is over is shared again by weight. The end of that
    process is one price per weight: the largest (words left) / (weight left) over the sources in the order
    in which they fill up. There is one row per source here, after the aggregate.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((nth - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    fills = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.sum("source_size").over(everything) - before).withColumn("rest", F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("price", F.max(F.col("left") / F.col("rest")).over(everything))
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("price") * F.col("weight")).alias("target"))


def fold(units: str, seed: int, by_words: bool) -> str:
    """SQL that folds an array of open units in order: struct(carry, done). By words, the carried unit is always closed and its mass
    of words moves on; else probability moves between units of like size, and either may be closed, as in plain pivotal sampling."""
    a, s = "acc.carry", "(acc.carry.p + x.p)"
    u = f"(shiftrightunsigned(xxhash64({seed}L, {a}.doc_id, {a}.size, x.doc_id, x.size), 11) / 9007199254740992D)"
    took = f"if({u} < {a}.p, 1L, 0L)" if by_words else f"if({s} < 1D, 0L, 1L)"  # by words: sure at p >= 1, never at p <= 0
    opened = lambda y, p: f"named_struct('doc_id', {y}.doc_id, 'size', {y}.size, 'whole', {y}.whole, 'p', {p})"
    closed = lambda y: f"named_struct('doc_id', {y}.doc_id, 'size', {y}.size, 'copies', {y}.whole + {took})"
    step = lambda o, p, c: f"named_struct('carry', {opened(o, p)}, 'done', concat(acc.done, array({closed(c)})))"
    if by_words:
        move = step("x", f"x.p + ({a}.p - {took}) * {a}.size / x.size", a)
    else:
        rest = f"{s} - {took}"
        move = f"CASE WHEN if({s} < 1D, {u} * {s} >= {a}.p, {u} * (2D - {s}) < 1D - x.p) THEN {step('x', rest, a)} ELSE {step(a, rest, 'x')} END"
    kind = f"struct<carry: {UNIT}, done: array<{DONE}>>"
    zero = f"named_struct('carry', cast(null AS {UNIT}), 'done', cast(array() AS array<{DONE}>))"
    return f"aggregate({units}, cast({zero} AS {kind}), (acc, x) -> cast(CASE WHEN {a} IS NULL THEN named_struct('carry', x, 'done', acc.done) ELSE {move} END AS {kind}))"


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 1) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies. taken = copies * size.

    No document is taken more than `most` times. A null or empty text has size 0. A source without words
    has target 0 and takes none of its rows. Null ids and repeated rows are rows like others. Reruns agree: random numbers are hashes of ids and sizes. An empty table gives no rows.
    Columns other than doc_id, text and source are ignored.
    """
    return dealt(docs, weights, most, seed).select("doc_id", "size", "source_size", "target", "taken", "copies")


def size_of(text: str = "text") -> Column:
    """The words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def dealt(docs: DataFrame, weights, most: int, seed: int) -> DataFrame:
    """What mix returns, and the source."""
    sizes = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of().alias("size")), "mix-sizes")
    sources = saved(targets(sizes, weights, most), "mix-sources")
    few = small(sources.withColumnRenamed("source", "_source"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = sizes.join(few, F.col("source").eqNullSafe(F.col("_source"))).withColumn("share", share).select("doc_id", "source", "size", F.floor("share").alias("whole"), (F.col("share") - F.floor("share")).alias("p"))
    done = [rows.filter("p = 0 or size = 0").select("source", "doc_id", "size", F.col("whole").alias("copies"))]

    # classes of like size, cut further by hash so that the largest bucket holds about FAN_IN documents
    cls = F.floor(F.log2(F.col("size") + F.lit(1.0)) * 16).cast("long")
    most_in = sizes.groupBy("source", cls.alias("c")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    cuts = -(-most_in // FAN_IN) or 1
    cut = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(cuts))
    level, last, k = rows.filter("p > 0 and size > 0").select("source", cls.alias("cls"), cut.alias("cut"), F.lit(0).cast("long").alias("below"), F.struct("doc_id", "size", "whole", "p").alias("carry")), False, 0
    while True:  # the cuts of each class in a tree, and at last the classes of each source: one open document each
        order = F.struct((-F.col("carry.size")).alias("size"), "below", F.col("carry.doc_id").alias("doc_id"), "carry")
        folded = level.groupBy(*(["source"] if last else ["source", "cls", "cut"])).agg(F.sort_array(F.collect_list(order)).alias("units"))
        folded = folded.withColumn("f", F.expr(fold(f"transform(units, u -> cast(u.carry AS {UNIT}))", seed + k, by_words=last)))
        folded = saved(folded.select(*[c for c in folded.columns if c not in ("units", "f")], "f.carry", "f.done"), f"mix-level{k}")
        done.append(folded.select("source", F.explode("done").alias("d")).select("source", "d.doc_id", "d.size", "d.copies"))
        if last:
            break
        last, cuts, k = cuts == 1, -(-cuts // FAN_IN), k + 1
        level = folded.select("source", "cls", F.floor(F.col("cut") / FAN_IN).alias("cut"), F.col("cut").alias("below"), "carry")
    last = F.when(F.col("carry.p") >= 0.5, 1).otherwise(0)  # one document of each source
    done.append(folded.select("source", "carry.doc_id", "carry.size", (F.col("carry.whole") + last).alias("copies")))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.join(few, F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights=(1, 2, 3), most: int = 3, seed: int = 1) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs, whatever their names.

    Rows that agree in id, source and size share the copies that they were dealt together: each gets as many, and the first ones, by a hash of the text, one more.
    """
    id_, source, size, total, rows, nth, copies = free_names(docs, "_id", "_source", "_size", "_total", "_rows", "_nth", "_copies")
    key = [id_, source, size]
    by = dealt(docs, weights, most, seed).groupBy(F.col("doc_id").alias(f"k{id_}"), F.col("source").alias(f"k{source}"), F.col("size").alias(f"k{size}")).agg(F.sum("copies").alias(total), F.count(F.lit(1)).alias(rows))
    by = saved(by.filter(F.col(total) > 0), "mix-copies")
    marked = docs.withColumns({id_: F.col("doc_id").cast("long"), source: F.col("source"), size: size_of()})

    def with_copies(of: DataFrame) -> DataFrame:
        return marked.join(of, [F.col(k).eqNullSafe(F.col(f"k{k}")) for k in key])

    out, several = with_copies(by.filter(F.col(rows) == 1)).withColumn(copies, F.col(total)), by.filter(F.col(rows) > 1)
    if not several.isEmpty():
        order = Window.partitionBy(*key).orderBy(F.xxhash64("text"))
        more = with_copies(small(several)).withColumn(nth, F.row_number().over(order))
        out = out.unionByName(more.withColumn(copies, F.floor(F.col(total) / F.col(rows)) + F.when(F.col(nth) <= F.col(total) % F.col(rows), 1).otherwise(0)).drop(nth).filter(F.col(copies) > 0))
    return out.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
