"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least `least`, found for the pipeline.

A SimHash of 64 bits can't do this alone: two texts with a similarity of 0.8 differ in some 10 of its bits, and an index of
deletion variants for so many bits has segments too short to select anything. So pairs come from two indexes, the SimHash
links of simhash.py and bands of least hashes, and each pair is then compared exactly, shingle by shingle.

Texts with one shingle set are one node. A bucket's members are first compared to its least node, which unites most that are like
each other. Nodes of buckets that are still divided are then joined exactly, by a prefix filter: their shingles are ordered by rarity, two sets that
are alike share one near the start, and its places bound how many more they can share. That too goes by turns: each node is compared to a few
nodes, drawn at random, of each of its prefix shingles, and only nodes that are in different components after some turns meet in pairs. So a large group
of copies is not spread into pairs, nor is one of texts that are somewhat alike. A pair of similarity 0.8 shares a bucket with probability
1 - (1 - 0.8**ROWS)**BANDS, 0.9996; from there on nothing is left to chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import large_keys, one_row_each, saved, slices, spread, spread_join, tidy
from tidemark.llm.components import components
from tidemark.llm.simhash import fingerprint, links
from tidemark.llm.substring import cut, hashed

BANDS, ROWS = 20, 5
TURNS, HUBS = 3, 32  # turns in which nodes are compared to so many hubs of a shingle, before the rest meet
POSTINGS = 2000  # of a shingle, and a thousandth of all, beyond which they are dealt to several tasks
EPS = 1e-9
BLOCK = 4096  # shingles whose hashes are taken at once
_SALT, _FACTOR = (np.random.default_rng(6).integers(0, 2**63, (2, BANDS * ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)).reshape(2, 1, -1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted; ASCII capitals count as small. Fewer words are one shingle."""
    data = np.frombuffer(text.lower(), np.uint8)
    h = hashed(data, *cut(data))
    k = max(1, min(words, len(h)))
    if not len(h):
        return np.zeros(1, np.uint64)
    g = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        g = (g ^ (g >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(g ^ (g >> np.uint64(29)))


def node_of(shingles: np.ndarray) -> int:
    """The number of a shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes())).view(np.int64))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least hash of the set under each of BANDS * ROWS hash functions."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, ((shingles[at : at + BLOCK, None] ^ _SALT) * _FACTOR).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A key for each band, from its number and the least hashes of its rows."""
    rows = least.reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(rows[i].tobytes(), i)).view(np.int64)) for i in range(BANDS)]


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, th (a hash of the text), node, n (its shingles), fp (the SimHash) and keys (of the bands) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            nodes, sizes, fps, keys = [], [], [], []
            for text in b.column(2).to_pylist():
                shingles = shingle_set((text or "").encode(), words)
                nodes.append(node_of(shingles))
                sizes.append(len(shingles))
                fps.append(fingerprint(text, words))
                keys.append(band_keys(least_hashes(shingles)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "th", "node", "n", "fp", "keys"])
        b = None
        tidy()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, node long, n long, fp long, keys array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node and shingles of the wanted (doc_id, node): the texts of their rows are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set((t or "").encode(), words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "shingles"])
        b = None
        tidy()

    texts = docs.join(wanted.select(F.col("doc_id").alias("_wanted")).distinct(), F.col("doc_id").cast("long").eqNullSafe(F.col("_wanted")), "left_semi").select("text")
    found = texts.mapInArrow(run, "node long, shingles array<long>")
    return found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))


def compared(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b and alike: whether the Jaccard similarity is at least `least`. Pairs whose sizes rule that out aren't intersected."""
    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    na, nb = F.size("sa"), F.size("sb")
    alike = (F.least(na, nb) >= F.greatest(na, nb) * F.lit(least)) & (both >= (na + nb - both) * F.lit(least))
    return pairs.join(b, "b").join(a, "a").select("a", "b", alike.alias("alike"))


def near_copies(docs: DataFrame, words: int = 5, distance: int = 4, least: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, node and component_id (the smallest doc_id reachable over pairs of at least `least`).

    Null and empty texts are one node, like only to each other; texts of fewer words than a shingle are like only to equal ones. Null ids are never the
    smallest; a component of null ids alone has component_id null. Repeated rows repeat. An empty table gives no rows; columns other than doc_id and text are ignored.
    """
    told, of = components_of(docs, words, distance, least)
    named = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("node", "component_id", "rows")
    return spread_join(told.select("doc_id", "node"), saved(named, "copies-named"), "node", "rows", "doc_id")


def components_of(docs: DataFrame, words: int, distance: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(the rows of docs as `signed` tells them, each node with its least doc_id and its component)."""
    told = saved(signed(docs, words), "signed")
    nodes = saved(told.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.count(F.lit(1)).alias("rows")), "copy-nodes")
    # buckets of several nodes: under a band's key, under one fingerprint, and under a fingerprint's link to another
    prints = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    near = links(prints.select("fp"), distance)
    near = near.join(prints.select(F.col("fp").alias("a"), F.col("node").alias("na")), "a").join(prints.select(F.col("fp").alias("b"), F.col("node").alias("nb")), "b")
    near = near.select(F.xxhash64("na", "nb").alias("key"), F.explode(F.array("na", "nb")).alias("node"))
    members = nodes.select(F.explode("keys").alias("key"), "node").unionByName(nodes.select(F.xxhash64(F.lit("print"), "fp").alias("key"), "node")).unionByName(near)
    buckets = saved(with_least(members), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select(F.col("least").alias("doc_id"), "node")
    sets = saved(sets_of(docs, wanted, words), "shingle-sets")
    heads = buckets.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    found = saved(compared(heads, sets, least).filter("alike").select("a", "b"), "alike")
    joined = united(buckets, nodes.select("node", "n"), sets, components(found), least)
    return told, nodes.select("node", "least", "rows").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def united(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, joined: DataFrame, least: float) -> DataFrame:
    """The components (node, component) after all links between nodes of divided buckets are added to `joined`."""

    def with_links(pairs: DataFrame, name: str) -> DataFrame | None:
        more = saved(compared(pairs, sets, least).filter("alike").select("a", "b"), name)
        return None if more.isEmpty() else components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    posts = saved(postings(buckets, nodes, sets, joined, least), "postings")
    parts = large_keys(posts.groupBy("s").agg(F.count(F.lit(1)).alias("k")), "s", "k", POSTINGS)
    for turn in range(TURNS):
        now = with_links(to_hubs(posts, joined, turn, least, parts), "alike-hubs")
        if now is None:
            break
        joined = now
    now = with_links(apart(posts, joined, least, parts), "alike-apart")
    return joined if now is None else now


def placed(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """nodes with their component; a node without links is its own."""
    return nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def postings(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, joined: DataFrame, least: float) -> DataFrame:
    """node, n, s and at: the shingles s in the prefix of each node of a divided bucket, and their places there.

    Shingles are ordered by rarity among these nodes, those of one component alone first. Two sets with a similarity of `least` share a shingle of
    their first n - ceil(least * n) + 1; shingles of one component alone can't be that one, and aren't told.
    """
    of = placed(buckets.select("key", "node"), joined)
    divided = of.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    within = of.join(divided, "key", "left_semi").select("node", "component").distinct()
    each = sets.join(within, "node").select("node", "component", F.explode("shingles").alias("s"))
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"), (F.min("component") < F.max("component")).alias("crosses"))
    order = each.join(often, "s").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("crosses", "df", "s"))).alias("order")).join(nodes, "node")
    prefix = F.slice("order", F.lit(1), (F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(EPS)) + 1).cast("int"))
    return order.select("node", "n", F.posexplode(prefix).alias("at", "x")).filter("x.crosses").select("node", "n", F.col("x.s").alias("s"), "at")


def may_be_alike(least: float) -> Column:
    """Whether the aliases a and b, of different components, may be alike if the shingle they meet at is the first they share."""
    rest = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    sizes = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(least) - F.lit(EPS)
    return (F.col("a.component") != F.col("b.component")) & sizes & (rest >= (F.col("a.n") + F.col("b.n")) * F.lit(least / (1 + least)) - F.lit(EPS))


def to_hubs(posts: DataFrame, joined: DataFrame, turn: int, least: float, parts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of each node and up to HUBS hubs of each of its prefix shingles, drawn anew each turn: HUBS times the postings at most.

    parts: the frequent shingles and the parts that their postings are dealt to.
    """
    of = placed(posts, joined)
    central = F.col("at") * F.lit(1 + least) <= F.col("n") * F.lit(1 - least)  # few shingles of its own: it may be like others of its size
    hub = F.struct("node", "n", "at", "component")
    drawn = [F.max_by(hub, F.struct(central, F.xxhash64("node", "s", F.lit(turn * HUBS + i)))) for i in range(HUBS)]
    hubs = of.groupBy("s").agg(F.array_distinct(F.array(*drawn)).alias("hubs"), F.min("component").alias("x"), F.max("component").alias("y"))
    mine, hubs = spread(of, hubs.filter("x < y").select("s", F.inline("hubs")), "s", "node", parts)
    pairs = mine.alias("a").join(hubs.alias("b"), met() & may_be_alike(least))
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def met() -> Column:
    """Whether the aliases a and b are of one shingle and part."""
    return (F.col("a.s") == F.col("b.s")) & (F.col("a._part") == F.col("b._part"))


def apart(posts: DataFrame, joined: DataFrame, least: float, parts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of nodes that are still in different components and may be alike, each once.

    Of each shingle, the nodes outside its largest component meet all of its nodes, so a group that has been united isn't met with itself.
    """
    of = placed(posts, joined)
    counts = of.groupBy("s", "component").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("s").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("s", "main")
    of, main = spread(of, main, "s", "node", parts)
    of = saved(of.join(main, ["s", "_part"]).drop("_part"), "postings-apart")
    every, outside = spread(of, of.filter("component <> main"), "s", "node", parts)
    a, b = outside.alias("a"), every.alias("b")
    on = met() & ((F.col("b.component") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))) & may_be_alike(least)
    return a.join(b, on).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def with_least(members: DataFrame) -> DataFrame:
    """key, node and head, the least node of the key; keys of one node go. Members may come out of arrays, whose lengths Spark doesn't know: no broadcast."""
    heads = members.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("most")).filter("head < most").select("key", "head")
    return members.join(heads.hint("merge"), "key").select("key", "node", "head")


def keep_one(docs: DataFrame, words: int = 5, distance: int = 4, least: float = 0.8) -> DataFrame:
    """One row of each component, with the columns of docs: the one with the smallest id, then the smallest hash of its text.

    Rows are judged one by one: of rows that repeat an id and a text one stays, and null ids are later than all others. Columns may have any names.
    """
    told, of = components_of(docs, words, distance, least)
    rows = told.groupBy("node", "doc_id", "th").agg(F.count(F.lit(1)).alias("n")).join(of, "node")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "n")).alias("first")
    kept = saved(rows.groupBy("component").agg(first).select("first.doc_id", "first.th", "first.n"), "copies-kept")
    return one_row_each(docs, [F.col("doc_id").cast("long"), F.xxhash64("text")], kept)
