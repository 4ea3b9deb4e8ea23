"""Line-level quality classifier: a linear-chain conditional random field.

Every line of a text is labelled good or bad from its own features and those of the lines next to it. The chain
is trained in numpy on a bounded sample of labelled documents whose lines inherit the document's label.
Forward-backward marginals, weighted by line length, make the document's quality, which a logistic curve
fitted on the same sample maps to the score. Of a long training document, runs of lines spread over its whole
length are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.lexicon import STOP_WORDS
from quire.llm.tables import arrow_column, id_key, mapped
from quire.llm.tokens import _LANES, Piece, mix, pieces, spans_hash, words

#: At most so many labelled documents, and lines of each, are fitted; nothing else is bounded.
TRAIN_DOCS, TRAIN_LINES, RUNS = 4000, 48, 4
THRESHOLD = 0.7

_CLASSES = {"symbol": b"#*$%&|<>{}[]\\^~@_=+/", "upper": bytes(range(65, 91)), "digit": b"0123456789", "shout": b"!?", "pipe": b"|", "stop": b".,;:"}
_TABLES = np.zeros((len(_CLASSES), 256), np.int8)
for _i, _bytes in enumerate(_CLASSES.values()):
    _TABLES[_i, list(_bytes)] = 1
N_OWN = len(_CLASSES) + 9


def _word_set(texts: list[str]) -> np.ndarray:
    """Hashes of the words, each also with a full stop or comma after it, as a sorted array."""
    raw = [w + tail for t in texts for w in t.split() for tail in ("", ".", ",")]
    data = np.frombuffer("".join(raw).encode(), np.uint8)
    ends = np.cumsum([len(w.encode()) for w in raw])
    return np.unique(spans_hash(data, np.concatenate([[0], ends[:-1]]), ends))


_STOPS = _word_set(list(STOP_WORDS.values()))
_STOP_BITS = np.zeros(1 << 16, bool)
_STOP_BITS[(_STOPS & np.uint64(0xFFFF)).astype(np.int64)] = True


def is_stop(h: np.ndarray) -> np.ndarray:
    out = _STOP_BITS[(h & np.uint64(0xFFFF)).astype(np.int64)]
    at = np.flatnonzero(out)
    near = np.minimum(np.searchsorted(_STOPS, h[at]), len(_STOPS) - 1)
    out[at] = _STOPS[near] == h[at]
    return out


def _sums(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=total[1:])
    return (total[end] - total[start]).astype(np.float64)


@dataclass
class Lines:
    features: np.ndarray  # own and neighbours', a row per line with a word
    length: np.ndarray  # bytes
    first: np.ndarray  # offsets of the rows


def lines_of(p: Piece) -> Lines:
    """The lines that hold a word, with features."""
    breaks = np.flatnonzero(p.data == 10)
    begin = np.unique(np.concatenate([p.offsets[:-1], breaks + 1]))
    begin = begin[begin < len(p.data)]
    end = np.concatenate([begin[1:], [len(p.data)]])[: len(begin)]
    w = words(p)
    line = np.searchsorted(begin, w.start, "right") - 1
    n = np.bincount(line, minlength=len(begin))
    used = np.flatnonzero(n)
    begin, end, n = begin[used], end[used], n[used].astype(np.float64)
    of = np.searchsorted(used, line)
    k = len(used)
    row = np.searchsorted(p.offsets, begin, "right") - 1
    first = np.searchsorted(row, np.arange(p.rows + 1))
    own = np.zeros((k, N_OWN))
    if k:
        size = (w.end - w.start).astype(np.float64)
        chars = np.bincount(of, weights=size, minlength=k)
        for i, table in enumerate(_TABLES):
            own[:, i] = _sums(table[p.data], begin, end) / chars
        back = [np.zeros(len(of), bool) for _ in range(3)]
        for j, b in enumerate(back, 1):
            b[j:] = (w.hash[j:] == w.hash[:-j]) & (of[j:] == of[:-j])
        order = np.lexsort((w.hash, of))
        again = np.zeros(len(of), bool)
        again[order[1:]] = (w.hash[order][1:] == w.hash[order][:-1]) & (of[order][1:] == of[order][:-1])
        with np.errstate(over="ignore"):
            body = np.add.reduceat(mix(w.hash), np.searchsorted(of, np.arange(k)))
        order = np.lexsort((np.arange(k), body, row))
        seen = np.zeros(k, bool)
        seen[order[1:]] = (body[order][1:] == body[order][:-1]) & (row[order][1:] == row[order][:-1])
        # repeated pairs of words within the whole text
        pair = np.zeros(len(of), np.uint64)
        with np.errstate(over="ignore"):
            pair[2:] = mix(w.hash[2:] * _LANES[1] + w.hash[1:-1] * _LANES[2] + w.hash[:-2] * _LANES[3])
        order = np.lexsort((pair, w.row))
        twice = np.zeros(len(of), bool)
        twice[order[1:]] = (pair[order][1:] == pair[order][:-1]) & (w.row[order][1:] == w.row[order][:-1])
        last = p.data[np.maximum(w.end[np.searchsorted(of, np.arange(k), "right") - 1] - 1, 0)]
        m = len(_CLASSES)
        own[:, m] = np.log1p(n)
        own[:, m + 1] = chars / n / 10
        own[:, m + 2] = np.bincount(of, weights=back[0], minlength=k) / n
        own[:, m + 3] = np.bincount(of, weights=back[1] | back[2], minlength=k) / n
        own[:, m + 4] = np.bincount(of, weights=again, minlength=k) / n
        own[:, m + 5] = np.bincount(of, weights=is_stop(w.hash), minlength=k) / n
        own[:, m + 6] = seen
        own[:, m + 7] = np.bincount(of, weights=twice, minlength=k) / n
        own[:, m + 8] = np.isin(last, [46, 33, 63])
    left, right = np.zeros_like(own), np.zeros_like(own)
    if k > 1:
        same = row[1:] == row[:-1]
        left[1:][same] = own[:-1][same]
        right[:-1][same] = own[1:][same]
    return Lines(np.hstack([own, left, right]), (end - begin).astype(np.float64), first)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # of the features, for good against bad
    bias: float
    trans: np.ndarray  # 2 x 2
    curve: tuple[float, float]

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _marginals(((x - self.mean) / self.scale) @ self.weight + self.bias, self.trans, first)[0]

    @staticmethod
    def shares(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Good share of each row's lines by length, and the rows' lengths."""
        rows = len(first) - 1
        of = np.repeat(np.arange(rows), np.diff(first))
        weight = np.bincount(of, weights=length, minlength=rows)
        return np.bincount(of, weights=length * good, minlength=rows) / np.maximum(weight, 1e-9), weight

    def scores(self, lines: Lines) -> np.ndarray:
        """Of each row; 0 for one without words."""
        share, weight = self.shares(self.marginals(lines.features, lines.first), lines.length, lines.first)
        a, b = self.curve
        return np.where(weight > 0, 1 / (1 + np.exp(-np.clip(a * _logit(share) + b, -30, 30))), 0.0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _marginals(good: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line, and the expected transitions, by forward-backward over all rows side by side."""
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    begin, count = first[:-1][order], count[order]
    emit = np.stack([np.zeros_like(good), good], 1)
    steps = int(count[0]) if len(count) else 0
    active = np.searchsorted(-count, -np.arange(steps), "left")  # rows with more than t lines
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    for t in range(steps):
        at = begin[: active[t]] + t
        alpha[at] = emit[at] + (np.logaddexp.reduce(alpha[at - 1][:, :, None] + trans, 1) if t else 0)
    moved = np.zeros((2, 2))
    for t in range(steps - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        ahead = emit[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp.reduce(trans + ahead[:, None, :], 2)
        both = alpha[at][:, :, None] + trans + ahead[:, None, :]
        moved += np.exp(both - np.logaddexp.reduce(both.reshape(len(at), 4), 1)[:, None, None]).sum(0)
    total = alpha + beta
    return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), moved


def fit(x: np.ndarray, first: np.ndarray, length: np.ndarray, label: np.ndarray, rounds: int = 150) -> Model:
    """Maximum likelihood of the lines' labels, with an L2 term, by Adam; ``label``: 0 or 1 of each row."""
    if not len(x):
        x, first, length = np.zeros((1, 3 * N_OWN)), np.array([0, 1]), np.ones(1)
        label = np.array([1])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    del x  # a copy less on the driver
    y = np.repeat(label, np.diff(first)).astype(np.float64)
    cls = np.array([1 / max((y == 0).sum(), 1), 1 / max((y == 1).sum(), 1)])
    share = np.clip(cls / cls.max(), 0.2, 1)[y.astype(int)]  # the rarer label counts up to five times
    seen = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(inner)
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    theta = np.zeros(z.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for i in range(1, rounds + 1):
        p, moved = _marginals(z @ theta[:-5] + theta[-5], np.clip(theta[-4:], -2, 2).reshape(2, 2), first)
        err = (p - y) * share
        g = np.concatenate([z.T @ err, [err.sum()], (moved - seen).ravel()]) / len(y) + 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    model = Model(mean, scale, theta[:-5], theta[-5], np.clip(theta[-4:], -2, 2).reshape(2, 2), (1.0, 0.0))
    rows = len(first) - 1
    marginal = _marginals(z @ model.weight + model.bias, model.trans, first)[0]
    share = _logit(model.shares(marginal, length, first)[0])
    a, b = 1.0, 0.0
    t = np.where(label == 1, 0.99, 0.01)
    weight = np.where(label == 1, 1.0, min(1.0, max(0.2, (label == 0).mean()) / max((label == 0).mean(), 1e-9)))
    for _ in range(300 if rows > 1 else 0):
        p = 1 / (1 + np.exp(-np.clip(a * share + b, -30, 30)))
        e = (p - t) * weight
        a, b = np.clip(a - 0.1 * (e * share).mean(), 0.2, 5), b - 0.3 * e.mean()
    # the cut of best balanced accuracy, in the middle of the widest gap that has it, gets the score THRESHOLD
    order = np.argsort(share, kind="stable")
    bad, good = np.cumsum(label[order] == 0), np.cumsum(label[order] == 1)
    gap = np.diff(share[order])
    if rows > 1 and bad[-1] and good[-1] and gap.max() > 1e-6:
        right = np.where(gap > 1e-6, (bad / bad[-1] - good / good[-1])[:-1], -np.inf)
        i = int(np.where(right >= right.max() - 1e-12, gap, -1).argmax())
        b = float(_logit(np.array(THRESHOLD)) - a * (share[order[i]] + share[order[i + 1]]) / 2)
    model.curve = (float(a), float(b))
    return model


def _spread(n: int) -> np.ndarray:
    """Up to ``TRAIN_LINES`` of ``n`` lines: all, or ``RUNS`` runs of neighbouring lines at equal distances."""
    if n <= TRAIN_LINES:
        return np.arange(n)
    size = TRAIN_LINES // RUNS
    return (np.linspace(0, n - size, RUNS).astype(np.int64)[:, None] + np.arange(size)).ravel()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p in pieces(batch.column(1)):
            got = lines_of(p)
            use = [got.first[r] + _spread(got.first[r + 1] - got.first[r]) for r in range(p.rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(p.first, p.rows), pa.array([got.features[u].astype(np.float32).tobytes() for u in use], pa.binary()), pa.array([got.length[u].tobytes() for u in use], pa.binary())],
                names=["label", "x", "length"],
            )


def train(docs: DataFrame, labels: DataFrame, held_out: str = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2") -> Model:
    """Fits on at most ``TRAIN_DOCS`` labelled documents outside ``held_out``, in the order of a hash of ``doc_id``.

    A document with both labels is not learnt from.
    """
    known = labels.where(f"doc_id is not null and quality in (0, 1) and not ({held_out})").select(id_key(labels).alias("id"), F.col("quality").cast("int").alias("label"))
    picked = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").orderBy(F.xxhash64("id"), "id").limit(TRAIN_DOCS)
    sample = docs.select(id_key(docs).alias("id"), "text").where("text is not null").join(F.broadcast(picked.select("id", "label")), "id").select("label", "text")
    rows = mapped(sample, _features, "label int, x binary, length binary").toPandas()
    rows = rows.sort_values(["label", "x"], kind="stable")  # the order of partitions must not matter
    first = np.concatenate([[0], np.cumsum([len(b) // (12 * N_OWN) for b in rows["x"]])]).astype(np.int64)
    length = np.concatenate([np.zeros(0)] + [np.frombuffer(b) for b in rows["length"]])
    label = rows["label"].to_numpy(int)
    x = np.empty((first[-1], 3 * N_OWN))
    for a, b, raw in zip(first[:-1], first[1:], rows.pop("x"), strict=True):
        x[a:b] = np.frombuffer(raw, np.float32).reshape(-1, 3 * N_OWN)
    del rows
    return fit(x, first, length, label)


def score_column(docs: DataFrame, model: Model) -> Column:
    """The score of ``text``; null and empty texts have 0."""

    def score(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(lines_of(p)) for p in pieces(text))]))

    return arrow_column(docs.sparkSession, score, "double", F.col("text"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 if score >= 0.7).

    Scores come from the text alone. Null and empty texts score 0. Null or other labels than 0 and 1, and documents
    labelled both ways, are not learnt from; without labels of both kinds the score says little but is defined.
    Repeated rows get equal scores; ``doc_id`` may have any type; an empty table gives an empty one; extra columns
    are not read.
    """
    out = docs.select("doc_id", score_column(docs, train(docs, labels)).alias("score"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; columns unchanged, whatever their names and types."""
    return docs.where(score_column(docs, train(docs, labels)) >= THRESHOLD)
