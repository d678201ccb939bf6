"""Best-fit packing of tokenised documents into sequences, by several capacities at once.

Texts are tokenised where they lie and never move; what moves is a row per piece. Pieces are dealt by hash to groups
of bounded size, and each group is packed by vector best-fit decreasing.
"""

from __future__ import annotations

import itertools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import saved

TOKENIZER = "byte_bpe_50k.json"
SIZE = 2048
GROUP = 8192
CACHE = 400_000
#: A run of white space that a split at single spaces would cut: such texts are encoded whole.
UNSAFE = re.compile(r"\s \s")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_LOADED: dict[str, object] = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary file (vocab and merges in JSON), from its ranks.

    The vocabulary splits a text at each single space before a word, so that the words between
    spaces have the same ids in every text; they're kept in a bounded cache.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, added = file["model"]["vocab"], {t["content"]: t["id"] for t in file["added_tokens"]}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; others follow from 256 on
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in added}
        self.encode = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cache: dict[str, tuple[int, ...]] = {}
        self.added, self.is_added = added, re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def ids(self, text: str) -> array:
        """The ids of a text; the vocabulary's added tokens stand for themselves, and what is between them is encoded apart."""
        if not any(t in text for t in self.added):
            return self.plain(text)
        out = array("I")
        for part in self.is_added.split(text):
            out.extend([self.added[part]] if part in self.added else self.plain(part))
        return out

    def plain(self, text: str) -> array:
        if " " not in text or UNSAFE.search(text):
            return array("I", self.encode(text))
        cache, encode = self.cache, self.encode
        first, *words = text.split(" ")
        for w in set(words).difference(cache):
            cache[w] = tuple(encode(" " + w))
        out = array("I", encode(first))
        out.extend(itertools.chain.from_iterable(map(cache.__getitem__, words)))
        if len(cache) > CACHE:
            cache.clear()
        return out


def encoder(path: str) -> Encoder:
    """The encoder of a file, made once in each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first one has what the others, all of `size`, leave."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).ids
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "")
                ids.append(end_id)
                raw = memoryview(ids.tobytes())
                for k, (s, n) in enumerate(cut(len(ids), size)):
                    for col, v in zip(out, (doc_id, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: int, weights=(1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, given in packing order.

    Each piece adds its tokens, one document and its attention cost (tokens squared) to a bin and fits if no capacity is passed.
    Of the bins that fit it goes to the one with the least weighted norm of what is left of each capacity (norm), or the
    largest weighted dot product of its needs with what is left (dot); else to a new bin.
    """
    caps, w = np.array([tokens, documents, cost], float), np.array(weights)
    left = np.empty((len(lengths), 3))
    bins, offsets, open_, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), np.empty(0, np.int64), 0
    least = np.minimum.accumulate(lengths[::-1])[::-1]  # of what is still to come
    for i, n in enumerate(lengths):
        need = np.array([n, 1, n * n], float)
        rest = left[open_] - need
        fits = np.flatnonzero((rest >= 0).all(axis=1)) if len(open_) else open_
        if len(fits):
            x = rest[fits] / caps
            k = fits[np.argmin((w * x * x).sum(axis=1)) if rule == "norm" else np.argmax((w * (x + need / caps) * (need / caps)).sum(axis=1))]
            b = open_[k]
        else:
            b, made = made, made + 1
            left[b] = caps
            open_ = np.append(open_, b)
            k = len(open_) - 1
        bins[i], offsets[i] = b, tokens - left[b, 0]
        left[b] -= need
        if i + 1 < len(lengths) and (left[b, 0] < least[i + 1] or left[b, 1] < 1):
            open_ = np.delete(open_, k)
    return bins, offsets


def pack(found: DataFrame, size: int = SIZE, group: int = GROUP, documents: int | None = None, cost: int | None = None, **how) -> DataFrame:
    """Pieces with sequence_id and offset. Groups of about `group` pieces are packed each by itself, longest first; a group's loss is below one sequence or so."""
    found = saved(found, "pieces")
    groups = max(1, -(-found.count() // group))
    caps = (size, documents or size, cost or size * size)

    def run(pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = best_fit(pdf["length"].to_numpy(), *caps, **how)
        return pdf.assign(sequence_id=pdf["g"].astype("int64") * 2**32 + bins, offset=offsets).drop(columns="g")

    dealt = found.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(run, f"{PIECES}, sequence_id long, offset long")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def packed(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Null ids and repeated rows are documents like others, each
    packed. Sequence numbers are unique and say nothing else. An empty table gives no rows; columns other than doc_id and text are ignored.
    With the capacities of documents and cost left out, neither can bind before the tokens do.
    """
    return pack(pieces(docs, path or tokenizer_path()), **how)
