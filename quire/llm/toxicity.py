"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first 4 to 7 bytes, so that
forms never seen in training share what their stems learnt. Filters of widths 1 to 3 run over the words,
max pooling keeps each filter's strongest response, and a logistic layer weighs them. All is trained in numpy
on a bounded sample; the embeddings start from the log-odds of their bucket in that sample. The cut-off is
calibrated for each language, told from function words, and shifted to the score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lexicon import STOP_WORDS
from quire.llm.tables import arrow_column, id_key, mapped
from quire.llm.tokens import Piece, mix, pieces, spans_hash, words

#: At most so many labelled documents of each kind are fitted, and of one with more words than this, so many in runs
#: spread over its whole length; nothing else is bounded.
TRAIN_TOXIC, TRAIN_OTHER, TRAIN_WORDS, RUNS = 2000, 4000, 4000, 8
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.5
_KINDS = 1 + len(STEMS)
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_LANGUAGES = sorted(STOP_WORDS)


def _stop_table() -> np.ndarray:
    out = np.zeros((len(_LANGUAGES), 1 << 16), bool)
    for i, lang in enumerate(_LANGUAGES):
        data = np.frombuffer(" ".join(STOP_WORDS[lang].split()).encode(), np.uint8)
        h = words(Piece(0, 1, data, np.array([0, len(data)])), keep=_LETTER).hash
        out[i, (h & np.uint64(0xFFFF)).astype(np.int64)] = True
    return out


_STOP = _stop_table()


def _folded(p: Piece) -> Piece:
    """Latin-1 capitals in UTF-8 lower-cased; A-Z are folded by the hash."""
    data = p.data.copy()
    if len(data) > 1:
        high = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[high] += 0x20
    return Piece(p.first, p.rows, data, p.offsets)


def tokens(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of each word's hash and stems (``BUCKETS`` where it is too short), offsets of the rows, language of each row."""
    p = _folded(p)
    w = words(p, keep=_LETTER)
    size = w.end - w.start
    out = np.empty((len(w.hash), _KINDS), np.int32)
    mask = np.uint64(BUCKETS - 1)
    out[:, 0] = w.hash & mask
    for i, n in enumerate(STEMS, 1):
        h = spans_hash(p.data, w.start, np.minimum(w.start + n, w.end))
        out[:, i] = np.where(size >= n, mix(h + np.uint64(i)) & mask, BUCKETS)
    low = (w.hash & np.uint64(0xFFFF)).astype(np.int64)
    votes = np.stack([np.bincount(w.row, weights=t[low], minlength=p.rows) for t in _STOP])
    return out, w.first, votes.argmax(0)


@dataclass
class Model:
    embed: np.ndarray  # BUCKETS + 1 by DIM; the last is zero
    filters: list[np.ndarray]  # width by DIM by FILTERS
    shift: list[np.ndarray]
    weight: np.ndarray
    bias: float
    cut: np.ndarray  # of each language

    def pooled(self, bucket: np.ndarray, first: np.ndarray, keep: bool = False):
        """Strongest response of each filter in each row; with ``keep`` also where it lies and the padded words."""
        rows, pad = len(first) - 1, max(WIDTHS)
        x = np.zeros((len(bucket) + rows * pad, DIM), np.float32)
        begin = first[:-1] + pad * np.arange(rows)
        at = np.arange(len(bucket)) + pad * np.repeat(np.arange(rows), np.diff(first))
        total = self.embed[bucket[:, 0]]
        for i in range(1, _KINDS):
            total += self.embed[bucket[:, i]]
        x[at] = total
        tall = np.vstack([x, np.zeros((pad, DIM), np.float32)])
        out = np.zeros((rows, len(WIDTHS) * FILTERS), np.float32)
        where = np.zeros_like(out, dtype=np.int64)
        for i, (f, s) in enumerate(zip(self.filters, self.shift, strict=True)):
            z = sum(tall[j : j + len(x)] @ f[j] for j in range(len(f))) + s
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            if rows:
                out[:, cols] = np.maximum.reduceat(z, begin, 0)
            if keep:
                ends = np.append(begin[1:], len(x))
                where[:, cols] = [lo + z[lo:hi].argmax(0) for lo, hi in zip(begin, ends, strict=True)]
        return (out, where, tall, at) if keep else out

    def logits(self, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(bucket, first), 0) @ self.weight + self.bias

    def scores(self, p: Piece) -> np.ndarray:
        bucket, first, lang = tokens(p)
        return 1 / (1 + np.exp(-np.clip(self.logits(bucket, first) - self.cut[lang], -30, 30).astype(np.float64)))


def _initial(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Embeddings from the log-odds of buckets whose documents are toxic more often than chance allows."""
    rng = np.random.default_rng(7)
    embed = np.zeros((BUCKETS + 1, DIM), np.float32)
    have, toxic = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for d, label in zip(docs, y, strict=True):
        seen = np.unique(d)
        have[seen] += 1
        toxic[seen] += label
    n, a = max(len(y), 1), y.sum()
    share = min(max(a / n, 1e-3), 0.999)
    odd = (toxic - have * share) / np.sqrt(np.maximum(have * share * (1 - share), 1e-9))
    gain = np.log((toxic + 0.3) / (a + 0.6)) - np.log((have - toxic + 0.3) / (n - a + 0.6))
    sure = (odd > 4.5) & (toxic >= 4)
    embed[:, 0] = np.where(sure, gain, 0) / 2
    # the other dimensions part the buckets at random, so that filters on them tell one marked word from several
    part = rng.integers(1, DIM, BUCKETS + 1)
    embed[np.flatnonzero(sure), part[sure]] = gain[sure] / 2
    embed[BUCKETS] = 0
    return embed


def fit(docs: list[np.ndarray], lang: np.ndarray, y: np.ndarray, epochs: int = 8, step: float = 0.01) -> Model:
    """Adam over mini-batches; ``docs``: buckets of each document's words."""
    rng = np.random.default_rng(11)
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0] += np.eye(DIM, FILTERS, dtype=np.float32) / len(f)
    model = Model(_initial(docs, y), filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -2.0, np.zeros(len(_LANGUAGES)))
    model.weight[::FILTERS] = 1
    if not len(y):
        return model
    fixed = model.embed.any(1)  # buckets that carried no signal stay zero: they would learn single documents
    params = lambda: [model.weight, *model.filters, *model.shift, model.embed]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params()]
    mb = vb = 0.0
    i = 0
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3))
    for _ in range(epochs if 0 < y.sum() < len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 64):
            i += 1
            pick = order[at : at + 64]
            first = np.concatenate([[0], np.cumsum([len(docs[j]) for j in pick])])
            bucket = np.concatenate([docs[j] for j in pick])
            pooled, where, x, place = model.pooled(bucket, first, keep=True)
            active = np.maximum(pooled, 0)
            err = ((1 / (1 + np.exp(-(active @ model.weight + model.bias))) - y[pick]) * share[pick] / len(pick)).astype(np.float32)
            back = err[:, None] * model.weight * (pooled > 0)
            grads = [active.T @ err + 1e-4 * model.weight]
            gx, gf, gs = np.zeros_like(x), [], []
            for k, f in enumerate(model.filters):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                g, spot = back[:, cols], where[:, cols]
                gf.append(np.stack([np.einsum("rfd,rf->df", x[spot + j], g) for j in range(len(f))]))
                gs.append(g.sum(0))
                for j in range(len(f)):
                    np.add.at(gx, (spot + j).ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, DIM))
            ge = np.zeros_like(model.embed)
            hit = np.flatnonzero(gx[place].any(1))
            for k in range(_KINDS):
                np.add.at(ge, bucket[hit, k], gx[place[hit]])
            ge[~fixed] = 0
            grads += [*gf, *gs, ge]
            for p, g, (m, v) in zip(params(), grads, moments, strict=True):
                if p is model.embed:  # only the rows that the batch moved
                    rows = np.flatnonzero(g.any(1))
                    m[rows] = 0.9 * m[rows] + 0.1 * g[rows]
                    v[rows] = 0.99 * v[rows] + 0.01 * g[rows] ** 2
                    p[rows] -= step * m[rows] / (np.sqrt(v[rows]) + 1e-6)
                    continue
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                p -= (step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
            gb = float(err.sum())
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            model.bias -= step * (mb / (1 - 0.9**i)) / (np.sqrt(vb / (1 - 0.99**i)) + 1e-6)
    out = np.concatenate([model.logits(np.concatenate(docs[j : j + 64]), np.concatenate([[0], np.cumsum([len(d) for d in docs[j : j + 64]])])) for j in range(0, len(docs), 64)])
    everywhere = _cut(out, y, 0.0)
    for k in range(len(_LANGUAGES)):
        mine = lang == k
        model.cut[k] = _cut(out[mine], y[mine], everywhere) if (y[mine] == 1).sum() >= 15 else everywhere
    return model


def _cut(z: np.ndarray, y: np.ndarray, default: float) -> float:
    """The logit of best balanced accuracy, in the middle of the widest gap that has it."""
    if not 0 < y.sum() < len(y):
        return default
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    gain = np.cumsum(y == 0) / (y == 0).sum() - np.cumsum(y == 1) / y.sum()
    gap = np.diff(z)
    gain = np.where(gap > 1e-6, gain[:-1], -np.inf)
    if not np.isfinite(gain).any():
        return default
    i = int(np.where(gain >= gain.max() - 1e-12, gap, -1).argmax())
    return float((z[i] + z[i + 1]) / 2)


def _spread(first: int, last: int) -> np.ndarray:
    if last - first <= TRAIN_WORDS:
        return np.arange(first, last)
    size = TRAIN_WORDS // RUNS
    return (np.linspace(first, last - size, RUNS).astype(np.int64)[:, None] + np.arange(size)).ravel()


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column(1)):
            bucket, first, lang = tokens(p)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(p.first, p.rows), pa.array([bucket[_spread(a, b)].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary()), pa.array(lang.astype(np.int32))],
                names=["label", "words", "lang"],
            )


def train(docs: DataFrame, labels: DataFrame, held_out: str = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0") -> Model:
    """Fits on at most ``TRAIN_TOXIC`` and ``TRAIN_OTHER`` labelled documents outside ``held_out``, in the order of a hash of ``doc_id``.

    A document with both labels is not learnt from; of documents that are near copies of each other in the sample, one is.
    """
    known = labels.where(f"doc_id is not null and toxic in (0, 1) and not ({held_out})").select(id_key(labels).alias("id"), F.col("toxic").cast("int").alias("label"))
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
    by_hash = [F.xxhash64("id"), F.col("id")]
    picked = known.where("label = 1").orderBy(*by_hash).limit(TRAIN_TOXIC).unionByName(known.where("label = 0").orderBy(*by_hash).limit(TRAIN_OTHER))
    sample = docs.select(id_key(docs).alias("id"), "text").where("text is not null").join(F.broadcast(picked), "id").select("label", "text")
    rows = mapped(sample, _sample_rows, "label int, words binary, lang int").toPandas().drop_duplicates().sort_values(["label", "words"], kind="stable")
    seen: set[int] = set()
    keep = []
    for label, raw in zip(rows["label"], rows["words"], strict=True):  # copies of a text with few changes count once
        d = np.frombuffer(raw, np.int32).reshape(-1, _KINDS)
        pair = mix(d[:-1, 0].astype(np.uint64) << np.uint64(20) ^ d[1:, 0].astype(np.uint64))
        marks = {int(mix(pair ^ np.uint64(s)).min()) for s in range(3)} if len(pair) else set()
        keep.append(not marks & seen)
        seen |= marks
    rows = rows[np.array(keep, bool)] if len(rows) else rows
    texts = [np.frombuffer(raw, np.int32).reshape(-1, _KINDS) for raw in rows["words"]]
    return fit(texts, rows["lang"].to_numpy(int), rows["label"].to_numpy(np.float64))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if score >= 0.5).

    Scores come from the text alone. Null and empty texts have no words and get the score of none. Null or other
    labels than 0 and 1, and documents labelled both ways, are not learnt from; without both kinds the model keeps its start and stays defined.
    Repeated rows get equal scores; an empty table gives an empty one; extra columns are not read.
    """
    model = train(docs, labels)

    def score(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(p) for p in pieces(text))]))

    out = docs.select("doc_id", arrow_column(docs.sparkSession, score, "double", F.col("text")).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
