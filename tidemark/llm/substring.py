"""Substring dedup over prefix-partitioned suffix trees.

A suffix begins at a word that has WINDOW - 1 more behind it in its document, and matters only to that depth: the tree is cut there. Its
internal nodes at depth WINDOW are the runs of WINDOW words that occur more than once; all leaves under such a node but the
earliest are repeats, and repeats that lie side by side make up the maximal repeats of a document. The way there:

1. Texts are put into batches of about half a million words, which get a number and stay as they are.
2. Prefixes. Suffixes are told apart by the hash of their first K words, and counted: each batch tells its distinct prefixes, dealt to
   buckets by prefix, and hears which of them occur once in the whole corpus (no internal node can lie below
   them, so those suffixes end here), more often, or so often that their subtree would not fit into memory.
3. Subtrees. The suffixes left go to the bucket of their prefix, those of too frequent prefixes to one of the whole WINDOW words, which is the
   longest prefix there is. They carry the hash of their next words (edges at depth K and STEP) and of all words after the prefix. In a bucket they
   are sorted; equal hashes from the prefix to depth WINDOW are one deep node. A batch first joins its own leaves, so a bucket holds one leaf
   of a deep node for each batch at most, and those of a too frequent prefix are dealt once more by batch, to be joined in two steps.
4. Every batch hears which of its suffixes are repeats, and drops the words under them.

Words are compared by 128 bits and more of hashes: a bucket's, and 32 of the prefix, 32 and 64 of what follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, groupby, islice
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, saved, tidy

WINDOW, K, STEP = 20, 5, 12
HOT = 65_536  # batches that hold a prefix before it is too frequent for one subtree
WORDS, BYTES = 2**19, 2**23  # of a batch
PER_BUCKET = 2**20  # suffixes for each bucket of prefixes, about
CHUNK, LONG = 2**17, 2**16  # bytes hashed at once, and of the longest word that is hashed with others
LAST = 2**63 - 1  # stands for a null id, which is later than any other
CORPUS = "src long, n long, dids binary, sizes binary, z binary"
PREFIXES = "bucket int, src long, low binary, twice binary"
ANSWERS = "src long, bucket int, again binary, hot binary"
LEAVES = "bucket int, src long, n int, names binary, places binary, dids binary"
MARKS = -1  # stands for a bucket where places are the numbers of suffixes that are repeats, and there are no names


def _powers(r: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(CHUNK + LONG, r, np.uint64))))


_FACTOR = 0x9E3779B97F4A7C15
_UP, _DOWN = _powers(_FACTOR), _powers(pow(_FACTOR, -1, 2**64))
_LETTER = np.random.default_rng(20).integers(1, 2**64, 256, np.uint64)
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def cut(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of each word of the bytes."""
    edges = np.flatnonzero(np.diff(_IS_SPACE[text], prepend=True, append=True))
    return edges[::2], edges[1::2]


def hashed(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes' random numbers, from running sums over a chunk of the text; very long words apart."""
    out = np.zeros(len(starts), np.uint64)
    for base in range(0, len(text), CHUNK):
        lo, hi = np.searchsorted(starts, (base, base + CHUNK))
        if lo < hi:
            sums = np.zeros(min(int(ends[hi - 1]) - base, CHUNK + LONG) + 1, np.uint64)
            np.cumsum(_LETTER[text[base : base + len(sums) - 1]] * _UP[: len(sums) - 1], out=sums[1:])
            first = starts[lo:hi] - base
            out[lo:hi] = (sums[np.minimum(ends[lo:hi] - base, len(sums) - 1)] - sums[first]) * _DOWN[first]
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]].tobytes())
    return out


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers in columns, each as differences and byte by byte, so that small steps take little room."""
    planes = [np.diff(c.astype(np.int64), prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(columns, 8, -1)
    return [np.cumsum(np.ascontiguousarray(p.T).view("<i8").ravel()) for p in planes]


def batches_of(rows: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """CORPUS rows of the texts of a task, in their order; a batch ends with the text that brings it to `most` words."""
    made, dids, texts, words, size = 0, [], [], 0, 0

    def out() -> pa.RecordBatch:
        src = (TaskContext.get().partitionId() << 32) + made
        z = zstandard.ZstdCompressor(level=1).compress(b" ".join(texts))
        return _batch(CORPUS, [(src, words, pack(np.array(dids, np.int64)), pack(np.fromiter(map(len, texts), np.int64, len(texts))), z)])

    for b in rows:
        for did, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = bytes(text.as_buffer() or b"")
            dids.append(did)
            texts.append(raw)
            words += len(raw.split())
            size += len(raw)
            if words >= most or size >= BYTES:
                yield out()
                made, dids, texts, words, size = made + 1, [], [], 0, 0
    if dids:
        yield out()


class Suffixes:
    """The suffixes of a batch, by number: at[i] is the first word of suffix i, doc[i] its text."""

    def __init__(self, dids: bytes, sizes: bytes, z: bytes, window: int, hashes: bool = False) -> None:
        self.text = zstandard.ZstdDecompressor().decompress(z)
        self.dids, lengths = unpack(dids, 1)[0], unpack(sizes, 1)[0]
        self.byte = np.concatenate(([0], np.cumsum(lengths + 1)))  # where each text begins; one space between
        data = np.frombuffer(self.text, np.uint8)
        self.starts, self.ends = cut(data)
        self.first = np.searchsorted(self.starts, self.byte)  # first word of each text
        n = np.diff(self.first)
        per = np.maximum(n - window + 1, 0)
        self.doc = np.repeat(np.arange(len(n)), per)
        self.at = np.arange(len(self.doc)) + np.repeat(self.first[:-1] - np.cumsum(per) + per, per)
        self.words = hashed(data, self.starts, self.ends) if hashes else None

    def name(self, which: np.ndarray, first: int, last: int) -> np.ndarray:
        """A hash of the words [first, last) of the suffixes `which`."""
        at, g = self.at[which], np.full(len(which), last - first, np.uint64)
        for j in range(first, last):
            g = (g ^ (g >> np.uint64(32))) * np.uint64(_FACTOR) + self.words[at + j]
        return mixed(g)


def mixed(g: np.ndarray) -> np.ndarray:
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(29))


def prefixes(s: Suffixes, bits: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct prefixes in order, the prefix of each suffix, how often each occurs): `bits` for the bucket and 32 more."""
    return np.unique(s.name(np.arange(len(s.at)), 0, k) >> np.uint64(32 - bits), return_inverse=True, return_counts=True)


def runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of the runs of equal values."""
    edges = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1], [True]))) if len(values) else np.zeros(1, int)
    return zip(values[edges[:-1]].tolist(), edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def in_batches(schema: str, rows: Iterator[tuple], many: int = 1024) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while part := list(islice(rows, many)):
        yield _batch(schema, part)
    rows = part = None
    tidy()


def bitmap(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).view(bool)


def tell_prefixes(corpus: Iterator[pa.RecordBatch], bits: int, window: int, k: int) -> Iterator[pa.RecordBatch]:
    """PREFIXES of each batch: by bucket its distinct prefixes, and which of them it holds several times."""

    def out() -> Iterator[tuple]:
        for src, _, dids, sizes, z in rows_of(corpus):
            s = Suffixes(dids, sizes, z, window, hashes=True)
            p, _, count = prefixes(s, bits, k)
            for bucket, x, y in runs(p >> np.uint64(32)):
                yield bucket, src, p[x:y].astype("<u4").tobytes(), bitmap(count[x:y] > 1)

    return in_batches(PREFIXES, out())


def count_prefixes(told: Iterator[pa.RecordBatch], hot: int) -> Iterator[pa.RecordBatch]:
    """ANSWERS: for each batch which of its prefixes occur again anywhere, and which are in over `hot` batches."""

    def answers() -> Iterator[tuple]:
        for bucket, group in groupby(rows_of(told), key=lambda r: r[0]):
            group = [(src, np.frombuffer(low, "<u4"), twice) for _, src, low, twice in group]
            values, count = np.unique(np.concatenate([low for _, low, _ in group]), return_counts=True)
            again = np.union1d(values[count > 1], np.concatenate([low[flags(twice, len(low))] for _, low, twice in group]))
            often = values[count > hot]
            for src, low, _ in group:
                yield src, bucket, bitmap(np.isin(low, again, assume_unique=True)), bitmap(np.isin(low, often, assume_unique=True)) if len(often) else b""

    return in_batches(ANSWERS, answers())


def deep_nodes(did: np.ndarray, start: np.ndarray, prefix: np.ndarray, edge: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves in tree order, whether each starts later than the first leaf of its deep node).

    Leaves are sorted by what they read from the prefix down; those that agree from the prefix to depth WINDOW lie under one node.
    """
    order = np.lexsort((start, did, rest, edge, prefix))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([n[order[1:]] != n[order[:-1]] for n in (prefix, edge, rest)])
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return order, (did[order] != did[lead]) | (start[order] != start[lead])


def whole_bucket(prefix: np.ndarray, rest: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """The bucket of all words of a suffix, from the last `bits` that its prefix keeps on the way and from the rest."""
    whole = mixed(prefix.astype("<u4").astype(np.uint64) ^ rest) + np.uint64(salt * _FACTOR % 2**64)
    return (whole >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(rest), np.int64)


def leaves(src: int, bucket: np.ndarray, number: np.ndarray, did: np.ndarray, start: np.ndarray, prefix: np.ndarray, edge: np.ndarray, rest: np.ndarray) -> Iterator[tuple]:
    """LEAVES rows of one batch, by bucket."""
    by = np.argsort(bucket, kind="stable")
    number, did, start, prefix, edge, rest = (x[by] for x in (number, did, start, prefix.astype("<u4"), edge.astype("<u4"), rest.astype("<u8")))
    for b, x, y in runs(bucket[by]):
        docs, of = np.unique(did[x:y], return_inverse=True)
        yield b, src, y - x, prefix[x:y].tobytes() + edge[x:y].tobytes() + rest[x:y].tobytes(), pack(number[x:y], of, start[x:y]), pack(docs)


def emit_leaves(rows: Iterator[pa.RecordBatch], bits: int, window: int, k: int, step: int, parts: int) -> Iterator[pa.RecordBatch]:
    """LEAVES of each batch: the suffixes whose prefix occurs again, but for those that the batch itself knows to be repeats, which are MARKS."""

    def out() -> Iterator[tuple]:
        for src, _, dids, sizes, z, answers in rows_of(rows):
            s = Suffixes(dids, sizes, z, window, hashes=True)
            p, of, _ = prefixes(s, bits, k)
            again, hot = np.zeros(len(p), bool), np.zeros(len(p), bool)
            at = {bucket: slice(x, y) for bucket, x, y in runs(p >> np.uint64(32))}
            for a in answers:
                there = at[a["bucket"]]
                again[there] = flags(a["again"], there.stop - there.start)
                if a["hot"]:
                    hot[there] = flags(a["hot"], there.stop - there.start)
            number = np.flatnonzero(again[of])
            prefix, edge, rest = p[of[number]], s.name(number, k, step) >> np.uint64(32), s.name(number, k, window)
            did, start = s.dids[s.doc[number]], s.at[number] - s.first[s.doc[number]]
            order, later = deep_nodes(did, start, prefix, edge, rest)
            if later.any():
                yield MARKS, src, 0, None, pack(np.sort(number[order[later]])), None
            mine = np.sort(order[~later])
            number, did, start, prefix, edge, rest = (x[mine] for x in (number, did, start, prefix, edge, rest))
            bucket, often = (prefix >> np.uint64(32)).astype(np.int64), hot[of[number]]
            if often.any():  # under the longest prefix, and dealt by batch
                bucket = np.where(often, (1 << bits) + whole_bucket(prefix, rest, bits, src % parts), bucket)
            yield from leaves(src, bucket, number, did, start, prefix, edge, rest)

    return in_batches(LEAVES, out())


def judge(rows: Iterator[pa.RecordBatch], bits: int, parts: int) -> Iterator[pa.RecordBatch]:
    """MARKS for each batch from whole buckets, and LEAVES again for the first of each deep node in a bucket that is a part."""

    def out() -> Iterator[tuple]:
        for bucket, group in groupby(rows_of(rows), key=lambda r: r[0]):
            if bucket == MARKS:
                yield from group
                continue
            group = list(group)
            srcs, sizes = [r[1] for r in group], [r[2] for r in group]
            prefix, edge, rest = (np.concatenate([np.frombuffer(r[3], t, n, at * n) for r, n in zip(group, sizes, strict=True)]) for t, at in (("<u4", 0), ("<u4", 4), ("<u8", 8)))
            places = [unpack(r[4], 3) for r in group]
            did = np.concatenate([unpack(r[5], 1)[0][of] for r, (_, of, _) in zip(group, places, strict=True)])
            number, start = (np.concatenate([x[i] for x in places]) for i in (0, 2))
            del group, places
            order, later = deep_nodes(did, start, prefix, edge, rest)
            repeat = np.zeros(len(order), bool)
            repeat[order[later]] = True
            end = 0
            for src, n in zip(srcs, sizes, strict=True):
                here = slice(end, end := end + n)
                r = repeat[here]
                if r.any():
                    yield MARKS, src, 0, None, pack(number[here][r]), None
                if parts > 1 and bucket >= 1 << bits and not r.all():
                    first = (x[here][~r] for x in (number, did, start, prefix, edge, rest))
                    yield from leaves(src, whole_bucket(prefix[here][~r], rest[here][~r], bits), *first)

    return in_batches(LEAVES, out())


def drop_repeats(rows: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words under no mark, joined by one space) and repeats (the maximal runs of words that go)."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    for _, _, dids, sizes, z, marks in rows_of(rows):
        s = Suffixes(dids, sizes, z, window)
        at = s.at[np.concatenate([np.zeros(0, np.int64), *(unpack(m, 1)[0] for m in marks or ())])]
        n = len(s.starts)
        gone = np.cumsum(np.bincount(at, minlength=n + 1) - np.bincount(at + window, minlength=n + 1))[:n] > 0
        before = np.concatenate(([0], np.cumsum(gone)))
        words, removed = np.diff(s.first), np.diff(before[s.first])
        out: list[tuple] = []
        for i, (did, w, r) in enumerate(zip(s.dids.tolist(), words.tolist(), removed.tolist(), strict=True)):
            text, spans = s.text[s.byte[i] : s.byte[i + 1] - 1].split(), []
            if r:
                mine = gone[s.first[i] : s.first[i + 1]]
                spans = [{"start": x, "end": y} for v, x, y in runs(mine) if v]
                text = compress(text, (~mine).tolist())
            kept = b" ".join(text)
            out.append((None if did == LAST else did, w, r, hashlib.sha256(kept).hexdigest(), kept.decode(), spans))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "repeats"])


def dedup(docs: DataFrame, window: int = WINDOW, k: int = K, step: int = STEP, hot: int = HOT, batch: int = WORDS, per_bucket: int = PER_BUCKET) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept (the text that stays), repeats (array of start, end in words).

    Windows are judged on the input. Null texts and texts under `window` words lose nothing. Rows of one id are one document:
    the earlier start counts, so rows that repeat id and text lose the same words. A null id is later than any other, and rows of null id are
    one document as well: of two that hold a passage at the same start neither loses it. An empty table gives no rows; columns other than
    doc_id and text are ignored.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("did"), "text")
    corpus = saved(texts.mapInArrow(lambda it: batches_of(it, batch), CORPUS), "corpus")
    words, batches = corpus.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bits, parts = min(24, max(0, ceil(log2(max(1, words) / per_bucket)))), -(-batches // hot) or 1
    tasks = max(8, 1 << bits)  # grows with the corpus, so that a task's share doesn't
    told = corpus.mapInArrow(lambda it: tell_prefixes(it, bits, window, k), PREFIXES).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    answers = saved(told.mapInArrow(lambda it: count_prefixes(it, hot), ANSWERS), "prefixes")
    heard = corpus.join(answers.groupBy("src").agg(F.collect_list(F.struct("bucket", "again", "hot")).alias("answers")), "src")

    def dealt(leaves: DataFrame) -> DataFrame:
        return leaves.repartition(tasks, F.when(F.col("bucket") == MARKS, F.xxhash64("src")).otherwise(F.col("bucket"))).sortWithinPartitions("bucket").mapInArrow(lambda it: judge(it, bits, parts), LEAVES)

    first = saved(dealt(heard.mapInArrow(lambda it: emit_leaves(it, bits, window, k, step, parts), LEAVES)), "repeats")
    discard(answers)
    marks = first.filter(F.col("bucket") == MARKS)
    if parts > 1:
        marks = marks.unionByName(saved(dealt(first.filter(F.col("bucket") != MARKS)), "repeats"))
    rows = corpus.join(marks.groupBy("src").agg(F.collect_list("places").alias("marks")), "src", "left")
    return rows.mapInArrow(lambda it: drop_repeats(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, repeats array<struct<start: bigint, end: bigint>>")


ORACLE = r"""WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, sha256(array_to_string(w[i:i+19], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM r), m AS (SELECT doc_id, count(*) AS n_removed FROM g GROUP BY doc_id),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) p LEFT JOIN g ON g.doc_id = p.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY p.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)"""
