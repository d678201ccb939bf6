"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is a run of at most 64 word characters; what is longer is cut into pieces. It comes in as its own vector, if the sample knows it, and as the mean of the vectors of its character
n-grams. A text is cut into windows of 32 words that overlap by half; each window is read in both
directions, the states are pooled by attention, and the text's score is its highest window's. In training too the highest
window of a text answers for its label. All windows of every text are scored, in blocks of fixed size.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, tidy

WORDS, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN = 16, 16, 12
GRAMS, VOCABULARY = 1 << 13, 20_000
CACHE, BLOCK = 100_000, 1024
#: The sample to learn from: so many rows of each label at most, by hash, and of texts of at most so many characters.
SAMPLE = {1: 1000, 0: 2000}
SAMPLE_CHARS = 10_000
EPOCHS, STEPS, BATCH, RATE = 8, 250, 64, 0.01  # passes over the sample: EPOCHS, or more where they make fewer than STEPS
THRESHOLD = 0.3
FIND = re.compile(r"\w+").findall
LONG = 64


def words_of(text: str) -> list[str]:
    """The words of a text. A run over LONG characters comes as pieces of so many, each with the last 4 of the one before, so that all n-grams are read."""
    words = FIND(text)
    if max(map(len, words), default=0) > LONG:
        words = [w[i : i + LONG] for w in words for i in range(0, max(1, len(w) - 4), LONG - 4)]
    return words


def _crc_table() -> np.ndarray:
    """What a byte does to the remainder of the CRC-32 of zlib."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, np.uint32(0xEDB88320) ^ (t >> np.uint32(1)), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed character n-grams of all words, one word after the other, and how many each has): first those of 3 bytes, then those of 4, of a word with its ends marked.

    A word has one character at least, so with its marks it has an n-gram. The hash is the CRC-32 of the bytes, taken for all places at once.
    """
    raw = [f"<{w}>".encode() for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw) + b"\0\0\0", np.uint8)
    state, hashes = np.full(int(size.sum()), 0xFFFFFFFF, np.uint32), []
    for n in range(4):
        state = _CRC[(state ^ data[n : n + len(state)]) & np.uint32(255)] ^ (state >> np.uint32(8))
        hashes.append(~state % np.uint32(GRAMS))
    end = np.cumsum(size)
    count = (size - 2) + (size - 3)
    first = np.cumsum(count) - count
    place = np.arange(len(state)) - np.repeat(end - size, size)  # in its word
    out = np.empty(int(count.sum()), np.int64)
    for n, skip in ((3, 0), (4, size - 2)):
        there = place <= np.repeat(size - n, size)
        out[(np.repeat(first + skip, size) + place)[there]] = hashes[n - 1][there]
    return out, count


@dataclass
class Network:
    """p: parameters by name. vocab: words of the sample, from 1 on; 0 is any other word."""

    p: dict[str, np.ndarray]
    vocab: dict[str, int]

    @classmethod
    def new(cls, vocab: dict[str, int], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        mat = lambda *s, k=None: (r.standard_normal(s) * (k or s[0] ** -0.5)).astype(np.float32)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        p = {"word": mat(len(vocab) + 1, WORD_DIM, k=0.1), "gram": mat(GRAMS, CHAR_DIM, k=0.3), "att": mat(2 * h, k=0.1), "out": mat(2 * h), "bias": np.array([-2.0], np.float32)}
        for way in "fb":
            p |= {f"W{way}": mat(d, 3 * h), f"U{way}": mat(h, 3 * h), f"c{way}": np.zeros(3 * h, np.float32)}
        return cls(p, vocab)


def windows(n: int) -> list[int]:
    """Starts of the windows of a text of n words: each word is in one, and each run of STRIDE words whole in one."""
    return list(range(0, max(1, n - (WORDS - STRIDE)), STRIDE))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def run_way(g: np.ndarray, there: np.ndarray, U: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, rows, HIDDEN) of one direction over inputs g (steps, rows, 3 HIDDEN); a step that isn't there changes nothing."""
    H = HIDDEN
    h = np.zeros((g.shape[1], H), np.float32)
    out = np.empty((len(g), g.shape[1], H), np.float32)
    for t in range(len(g)):
        hu = h @ U
        zr = sigmoid(g[t, :, : 2 * H] + hu[:, : 2 * H])
        z, r = zr[:, :H], zr[:, H:]
        n = np.tanh(g[t, :, 2 * H :] + r * hu[:, 2 * H :])
        m = there[t][:, None]
        new = n + z * (h - n)
        if not m.all():
            new = np.where(m, new, h)
        if keep is not None:
            keep.append((h, z, r, n, hu[:, 2 * H :], m))
        h = out[t] = new
    return out


def forward(p: dict, gf: np.ndarray, gb: np.ndarray, there: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each row. gf, gb: inputs of both directions, gb in reverse order of steps."""
    kf, kb = ([], []) if keep is not None else (None, None)
    hs = np.concatenate([run_way(gf, there, p["Uf"], kf), run_way(gb, there[::-1], p["Ub"], kb)[::-1]], axis=2)
    e = np.where(there, hs @ p["att"], -1e9)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[:, :, None] * hs).sum(axis=0)
    if keep is not None:
        keep |= {"hs": hs, "a": a, "pooled": pooled, "kf": kf, "kb": kb}
    return pooled @ p["out"] + p["bias"][0]


def back_way(dh: np.ndarray, keep: list, U: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of U, given those of the states."""
    H = HIDDEN
    dg, dU, carry = np.zeros((*dh.shape[:2], 3 * H), np.float32), np.zeros_like(U), 0.0
    for t in range(len(dh) - 1, -1, -1):
        h, z, r, n, un, m = keep[t]
        d = dh[t] + carry
        do = np.where(m, d, 0)
        dn = do * (1 - z) * (1 - n * n)
        dz = do * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dhu = np.concatenate([dz, dr, dn * r], axis=1)
        dg[t] = np.concatenate([dz, dr, dn], axis=1)
        dU += h.T @ dhu
        carry = np.where(m, do * z, d) + dhu @ U.T
    return dg, dU


def _mean_grams(p: dict, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The mean vector of each word's n-grams; ids holds them word after word."""
    first = np.concatenate(([0], np.cumsum(count[:-1].astype(np.int64))))
    return np.add.reduceat(p["gram"][ids], first, axis=0) / count[:, None]


def _sum_by(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sum of the rows of each."""
    order = np.argsort(ids, kind="stable")
    at = ids[order]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int | None = None) -> Network:
    """Fit a network to texts and labels. Without rows of both labels it scores by its starting bias alone."""
    number: dict[str, int] = {}  # words of the sample from 1 on; 0 pads
    docs = [array("I", (number.setdefault(w, len(number) + 1) for w in words_of(t.lower()))) for t in texts]
    epochs = epochs or max(EPOCHS, min(5 * EPOCHS, -(-STEPS * BATCH // max(1, len(docs)))))
    counts = np.bincount(np.concatenate([np.zeros(0, np.int64), *map(np.asarray, docs)]).astype(np.int64), minlength=len(number) + 1)
    words = list(number)
    often = sorted(np.flatnonzero(counts[1:] > 1).tolist(), key=lambda k: (-counts[k + 1], words[k]))[:VOCABULARY]
    vocab = {words[k]: i + 1 for i, k in enumerate(often)}
    net = Network.new(vocab, seed)
    if len(set(labels)) < 2:
        net.p["out"][:] = 0
        return net
    known = np.array([0, *(vocab.get(w, 0) for w in words)], np.int32)
    g_ids, sizes = grams(words)
    g_ids, sizes = np.concatenate(([0], g_ids)).astype(np.uint16), np.concatenate(([1], sizes))
    g_count, g_first = sizes.astype(np.float32), np.concatenate(([0], np.cumsum(sizes)))
    del number, words
    owner = np.repeat(np.arange(len(docs)), [len(windows(len(d))) for d in docs])
    rows, at = np.zeros((len(owner), WORDS), np.int32), 0
    for d in docs:
        for s in windows(len(d)):
            part = d[s : s + WORDS]
            rows[at, : len(part)] = part
            at += 1
    y = np.array(labels, np.float32)
    first = np.searchsorted(owner, np.arange(len(docs) + 1))
    r, p = np.random.default_rng(seed), net.p
    m1, m2 = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    weight, step = max(1.0, (len(y) - y.sum()) / max(1.0, y.sum()) / 2), 0
    for epoch in range(epochs):
        table = {way: np.empty((len(known), 3 * HIDDEN), np.float32) for way in "fb"}
        for i in range(0, len(known), BLOCK):  # a part of the words at a time
            x = np.concatenate([p["word"][known[i : i + BLOCK]], _mean_grams(p, g_ids[g_first[i] : g_first[min(i + BLOCK, len(known))]], g_count[i : i + BLOCK])], axis=1)
            for way in "fb":
                table[way][i : i + BLOCK] = x @ p[f"W{way}"] + p[f"c{way}"]
        logit = np.concatenate([_logits(p, table, rows[i : i + BLOCK]) for i in range(0, len(rows), BLOCK)])
        del table
        best = np.array([first[k] + (logit[first[k] : first[k + 1]].argmax() if epoch else r.integers(first[k + 1] - first[k])) for k in range(len(docs))])
        if not epoch:  # no window is known yet: start with several of each text
            best = np.concatenate([np.arange(first[k], first[k + 1])[:4] for k in range(len(docs))])
        order = r.permutation(best)
        for i in range(0, len(order), BATCH):
            batch = rows[order[i : i + BATCH]].T  # (steps, rows)
            there, want = batch > 0, y[owner[order[i : i + BATCH]]]
            used, at = np.unique(batch, return_inverse=True)
            at = at.reshape(batch.shape)
            lens = g_count[used].astype(int)
            flat = np.concatenate([g_ids[g_first[u] : g_first[u + 1]] for u in used])
            of = np.repeat(np.arange(len(used)), lens)
            x = np.concatenate([p["word"][known[used]], _mean_grams(p, flat, g_count[used])], axis=1)
            keep: dict = {}
            z = forward(p, (x @ p["Wf"] + p["cf"])[at], (x @ p["Wb"] + p["cb"])[at[::-1]], there, keep)
            dz = ((sigmoid(z) - want) * np.where(want > 0, weight, 1) / len(want)).astype(np.float32)
            grad = {"out": keep["pooled"].T @ dz, "bias": np.array([dz.sum()], np.float32)}
            dp = dz[:, None] * p["out"]
            hs, a = keep["hs"], keep["a"]
            da = (hs * dp).sum(axis=2)
            de = a * (da - (a * da).sum(axis=0))
            grad["att"] = np.einsum("tn,tnh->h", de, hs)
            dh = a[:, :, None] * dp + de[:, :, None] * p["att"]
            dx = np.zeros_like(x)
            for way, k, d, idx in (("f", "kf", dh[:, :, :HIDDEN], at), ("b", "kb", dh[::-1, :, HIDDEN:], at[::-1])):
                dg, grad[f"U{way}"] = back_way(d, keep[k], p[f"U{way}"])
                per = _sum_by(idx.ravel(), dg.reshape(-1, 3 * HIDDEN))[1]  # every used word is there
                grad[f"W{way}"], grad[f"c{way}"] = x.T @ per, per.sum(axis=0)
                dx += per @ p[f"W{way}"].T
            step += 1
            scale = RATE * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            sparse = {"word": (known[used], dx[:, :WORD_DIM]), "gram": (flat, (dx[:, WORD_DIM:] / g_count[used][:, None])[of])}
            for name, (ids, d) in sparse.items():
                u, total = _sum_by(ids, d)
                m1[name][u] = 0.9 * m1[name][u] + 0.1 * total
                m2[name][u] = 0.999 * m2[name][u] + 0.001 * total**2
                p[name][u] -= scale * m1[name][u] / (np.sqrt(m2[name][u]) + 1e-8)
            for name, d in grad.items():
                m1[name] = 0.9 * m1[name] + 0.1 * d
                m2[name] = 0.999 * m2[name] + 0.001 * d**2
                p[name] -= (scale * m1[name] / (np.sqrt(m2[name]) + 1e-8)).astype(np.float32)
    return net


def _logits(p: dict, table: dict, rows: np.ndarray) -> np.ndarray:
    ids = rows.T
    return forward(p, table["f"][ids], table["b"][ids[::-1]], ids > 0)


class Scorer:
    """Scores texts with a network; what words put in is kept in a bounded cache."""

    def __init__(self, net: Network) -> None:
        self.net, self.number = net, {}
        self.table = {way: np.zeros((1024, 3 * HIDDEN), np.float32) for way in "fb"}  # row 0 pads; grows by doubling

    def ids(self, words: list[list[str]]) -> list[list[int]]:
        number, p = self.number, self.net.p
        if len(number) > CACHE:
            number.clear()
        new = sorted({w for d in words for w in d}.difference(number))
        if new:
            at = len(number) + 1
            number |= {w: at + i for i, w in enumerate(new)}
            g_ids, n = grams(new)
            chars = _mean_grams(p, g_ids, n.astype(np.float32))
            x = np.concatenate([p["word"][[self.net.vocab.get(w, 0) for w in new]], chars], axis=1)
            for way in "fb":
                while len(self.table[way]) < at + len(new):
                    self.table[way] = np.concatenate([self.table[way], np.zeros_like(self.table[way])])
                self.table[way][at : at + len(new)] = x @ p[f"W{way}"] + p[f"c{way}"]
        return [list(map(number.__getitem__, d)) for d in words]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text: its highest window's; 0 without words."""
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 64):
            ids = self.ids([words_of((t or "").lower()) for t in texts[at : at + 64]])
            owner, starts = [], []
            for k, d in enumerate(ids):
                w = windows(len(d)) if d else []
                owner += [k] * len(w)
                starts += w
            for i in range(0, len(owner), BLOCK):
                part = [ids[k][s : s + WORDS] for k, s in zip(owner[i : i + BLOCK], starts[i : i + BLOCK], strict=True)]
                rows = np.array([x + [0] * (WORDS - len(x)) for x in part], np.int32)
                np.maximum.at(out, at + np.array(owner[i : i + BLOCK]), sigmoid(_logits(self.net.p, self.table, rows)))
        return out


def sample(docs: DataFrame, labels: DataFrame, learn) -> DataFrame:
    """doc_id, text and _toxic of a bounded sample of the labelled rows that learn (an expression over doc_id) holds for.

    The sample's ids are few by the parameter, so they are broadcast; texts aren't moved. Ids are drawn first: those that are drawn but have no text, or one
    of over SAMPLE_CHARS characters, fall out. A label given twice counts as toxic if one of the two is.
    """
    of = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64("doc_id")
    ids = None
    for value, n in SAMPLE.items():
        part = of.filter(F.col("toxic") == value).orderBy(by_hash, "doc_id").limit(n)
        ids = part if ids is None else ids.unionByName(part)
    ids = ids.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    texts = docs.select("doc_id", "text").filter(F.char_length("text").between(1, SAMPLE_CHARS))
    return texts.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "_toxic").dropDuplicates(["doc_id"])


def fitted(docs: DataFrame, labels: DataFrame) -> Network:
    """The network that the sample teaches. One task trains it, so that the driver holds neither texts nor what training takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        net = train([r[1] for r in rows], [r[2] for r in rows])
        out = pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["network"])
        del rows, net
        tidy()
        yield out

    got = sample(docs, labels, ~held_out()).coalesce(1).mapInArrow(run, "network binary").collect()
    return pickle.loads(got[0].network) if got else train([], [])


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Scores are made of the text alone. A text without words scores 0. Null ids are not held out; they and repeated rows
    are scored like others. With no labels to learn from, every text with words scores the starting bias. An empty table gives no rows.
    Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scorer.scores(batch.column(2).to_pylist()))], ["doc_id", "held_out", "score"])
        scorer = batch = None
        tidy()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    out = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their columns, of whatever names; each row is judged by itself, in the task that reads it.

    Null and empty texts score 0 and stay. Null ids and repeated rows are rows like others. With no labels to learn from, nothing goes. An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in slices(batches):
            yield batch.filter(pa.array(scorer.scores(batch.column(at).to_pylist()) < THRESHOLD))
        scorer = batch = None
        tidy()

    return docs.mapInArrow(run, docs.schema)
