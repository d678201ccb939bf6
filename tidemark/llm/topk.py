"""Exact top-k search over a bit-sliced index.

Vectors become integers. The index holds blocks of rows; in a block each component is quantised to few bits and
stored as bit slices, one bit per row. A query's scores are added up slice by slice with carry-save
bitmap arithmetic for all rows of the block at once, many queries side by side. The k best are selected from the most
significant slice downward; every row whose quantised score is within the proven rounding bound of the k-th is then
scored exactly. So the answer is exact, and most rows are never scored one by one.

Queries come in blocks too, and every block of queries meets every block of rows in one join: blocks are dealt to the rows and columns of a
grid, whose cells are its tasks, so neither side passes through the driver or has to fit into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import saved

SCALE = 256
BLOCK = 8192  # rows of the index in a block
KEEP = 7  # bits of a component in the slices
SIDE = 64  # queries side by side
CHUNK = 4096  # queries in a block
PAIRS = 16  # pairs of blocks in a cell of the grid, once there are more pairs than blocks of rows
INDEX = "n int, dims int, shift int, width int, at int, ids binary, slices binary, exact binary"
ASKED = "q_n int, q_dims int, q_at int, q_ids binary, q_ints binary"


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and ints: floor(SCALE * x) by component. Null ids, null vectors and those with null or non-finite components are left out."""
    v = F.col("v")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * SCALE)).alias("ints"))


def _matrix(rows: list, dims: int) -> np.ndarray:
    out = np.zeros((len(rows), dims), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def slices_of(values: np.ndarray, keep: int = KEEP) -> tuple[int, np.ndarray]:
    """(shift, slices): component = its least + (quantised << shift) + rest, rest in [0, 2**shift); slices[d, b] is a bitmap of bit b."""
    up = values - values.min(axis=0)
    shift = max(0, int(up.max()).bit_length() - keep)
    words = -(-len(values) // 64)
    bits = np.zeros((values.shape[1], keep, words * 64), np.uint8)
    for b in range(keep):
        bits[:, b, : len(values)] = ((up >> (shift + b)) & 1).T
    return shift, np.packbits(bits, axis=2, bitorder="little").view("<u8")


def _batch(schema: str, row: list) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([v], {"int": pa.int32(), "binary": pa.binary()}[t]) for v, (_, t) in zip(row, fields, strict=True)], [n for n, _ in fields])


def in_blocks(rows: DataFrame, size: int, make, schema: str) -> DataFrame:
    """Blocks of up to `size` rows, cut from each partition as it lies: make(ids, vectors, number), where numbers differ between partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, at = [], [], TaskContext.get().partitionId()
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield _batch(schema, make(ids, vectors, at))
                    ids, vectors, at = [], [], at + 1
        if ids:
            yield _batch(schema, make(ids, vectors, at))

    return rows.mapInArrow(run, schema)


def index_block(ids: list, vectors: list, at: int) -> list:
    """An INDEX row; the exact integers in as few bytes as hold them all."""
    values = _matrix(vectors, max(1, *map(len, vectors)))
    shift, slices = slices_of(values)
    width = next(w for w in (2, 4, 8) if w == 8 or np.abs(values).max() < 1 << (8 * w - 1))
    return [len(ids), values.shape[1], shift, width, at, np.array(ids, "<i8").tobytes(), slices.tobytes(), values.astype(f"<i{width}").tobytes()]


def query_block(ids: list, vectors: list, at: int) -> list:
    """An ASKED row."""
    values = _matrix(vectors, max(1, *map(len, vectors)))
    return [len(ids), values.shape[1], at, np.array(ids, "<i8").tobytes(), values.astype("<i8").tobytes()]


def grid(rows: int, queries: int, row_bytes: int, query_bytes: int) -> tuple[int, int]:
    """(bands of blocks of rows, bands of blocks of queries) of a grid where each cell has about PAIRS pairs and little is copied.

    Each block of rows goes to every band of queries and the other way round, so the bands are weighed by the bytes of the sides.
    """
    if not rows or not queries:
        return 1, 1
    cells = max(rows, -(-rows * queries // PAIRS))
    columns = min(queries, max(1, round((cells * query_bytes / max(1, row_bytes)) ** 0.5)))
    return max(1, min(rows, -(-cells // columns))), columns


def add_slices(slices: np.ndarray, queries: np.ndarray) -> list[np.ndarray]:
    """Score slices, each (queries, words): the sum over d of |q_d| times the quantised component, or its complement where q_d < 0."""
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    size, keep = np.abs(queries), slices.shape[1]
    flip = np.where(queries < 0, ones, np.uint64(0))  # (queries, dims)
    bits = int(size.max()).bit_length()
    waiting: list[list[np.ndarray]] = [[] for _ in range(bits + keep + 1)]
    result, c = [], 0
    while c < len(waiting):
        column = waiting[c]
        if c + 1 == len(waiting):
            waiting.append([])
        for j in range(max(0, c - keep + 1), min(bits, c + 1)):
            on = np.where((size >> j) & 1, ones, np.uint64(0))
            for d in np.flatnonzero(on.any(axis=0)):
                column.append((slices[d, c - j] ^ flip[:, d, None]) & on[:, d, None])
                while len(column) >= 3 and len(column) % 2:  # full adders as early as may be
                    x, y, z = column.pop(), column.pop(), column.pop()
                    t = x ^ y
                    column.append(t ^ z)
                    waiting[c + 1].append((x & y) | (t & z))
                    break
        while len(column) >= 3:
            x, y, z = column.pop(), column.pop(), column.pop()
            t = x ^ y
            column.append(t ^ z)
            waiting[c + 1].append((x & y) | (t & z))
        if len(column) == 2:
            x, y = column
            column[:] = [x ^ y]
            waiting[c + 1].append(x & y)
        result.append(column[0] if column else None)
        waiting[c] = []
        if not any(waiting[c + 1 :]) and c >= bits + keep - 2:
            break
        c += 1
    zero = np.zeros((len(queries), slices.shape[2]), np.uint64)
    return [zero if r is None else r for r in result]


def select(scores: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each query (the least, if there are fewer rows), from the most significant slice downward."""
    n, words = scores[0].shape
    above, tied = np.zeros((n, words), np.uint64), np.broadcast_to(valid, (n, words)).copy()
    kth = np.zeros(n, np.int64)
    for b in range(len(scores) - 1, -1, -1):
        high = tied & scores[b]
        enough = np.bitwise_count(above | high).sum(axis=1, dtype=np.int64) >= k
        kth += enough.astype(np.int64) << b
        above = np.where(enough[:, None], above, above | high)
        tied = np.where(enough[:, None], high, tied & ~scores[b])
    return kth


def at_least(scores: list[np.ndarray], valid: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Bitmaps of the rows whose score is bound or more."""
    bound = np.maximum(bound, 0)
    above, tied = np.zeros_like(scores[0]), np.broadcast_to(valid, scores[0].shape).copy()
    for b in range(len(scores) - 1, -1, -1):
        one = ((bound >> b) & 1).astype(bool)[:, None]
        high = tied & scores[b]
        above = np.where(one, above, above | high)
        tied = np.where(one, high, tied & ~scores[b])
    return above | tied


def search_block(block: dict, q_ids: np.ndarray, q_ints: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, row ids, scores) of each query's k best rows in a block, its own id left out."""
    n, dims, shift = block["n"], block["dims"], block["shift"]
    ids, exact = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["exact"], f"<i{block['width']}").reshape(n, dims)
    words = -(-n // 64)
    slices = np.frombuffer(block["slices"], "<u8").reshape(dims, KEEP, words)
    valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view("<u8")
    most = int(np.unique(ids, return_counts=True)[1].max())
    qs = np.zeros((len(q_ints), dims), np.int64)
    qs[:, : min(dims, q_ints.shape[1])] = q_ints[:, :dims]
    for at in range(0, len(qs), SIDE):
        q = qs[at : at + SIDE]
        scores = add_slices(slices, q)
        kth = select(scores, valid, k + most)  # its own rows may be among the best
        off = (np.abs(q).sum(axis=1) * ((1 << shift) - 1)) >> shift  # what the bits left out may change, in quantised units
        near = at_least(scores, valid, kth - off - 1)
        for i, row in enumerate(near):
            found = np.flatnonzero(np.unpackbits(row.view(np.uint8), bitorder="little"))
            found = found[ids[found] != q_ids[at + i]]
            s = exact[found].astype(np.int64) @ q[i]
            best = np.lexsort((ids[found], -s))[:k]
            yield np.full(len(best), q_ids[at + i]), ids[found][best], s[best]


def top_k(vectors: DataFrame, is_query, k: int = 5, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows with the largest integer inner product, ties to the smaller id.

    Queries are the rows that is_query (a column expression over vec_id) holds for, candidates all rows but those of the query's own id.
    Null vectors, ids, and vectors with null or non-finite components take no part. Shorter vectors count as
    padded with zeros. Of rows that repeat an id, all are candidates, and the least vector asks. An empty table gives no rows.
    Columns other than vec_id and embedding are ignored. Scores must fit 64 bits.
    """
    rows = usable(vectors)
    index = saved(in_blocks(rows, block, index_block, INDEX), "bit-slices")
    queries = rows.filter(is_query).groupBy("vec_id").agg(F.min("ints").alias("ints"))
    asked = saved(in_blocks(queries, chunk, query_block, ASKED), "queries")
    sizes = [t.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(c)), F.lit(0))).first() for t, c in ((index, "exact"), (asked, "q_ints"))]
    bands, columns = grid(sizes[0][0], sizes[1][0], sizes[0][1], sizes[1][1])
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.withColumn("band", F.pmod("at", F.lit(bands))).withColumn("column", spread(columns))
    right = asked.withColumn("column", F.pmod("q_at", F.lit(columns))).withColumn("band", spread(bands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in batch.to_pylist():
                q_ids, q_ints = np.frombuffer(pair["q_ids"], "<i8"), np.frombuffer(pair["q_ints"], "<i8").reshape(pair["q_n"], pair["q_dims"])
                parts = list(search_block(pair, q_ids, q_ints, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], ["query_id", "vec_id", "score"])

    hits = saved(left.join(right, ["band", "column"]).mapInArrow(run, "query_id long, vec_id long, score long"), "hits")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5"""
