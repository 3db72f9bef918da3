"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams, hashed into a table of vectors; a text is the mean over its distinct words of the mean
of their n-grams' vectors; two softmax outputs are linear in it. A misspelt word that training never saw shares most of
its n-grams with the right one, and so its vector. As the model is linear behind the table, scoring folds it into one
number per n-gram: a word's logit is the mean of its n-grams' numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .encoding import release

#: Labelled rows, and bytes of their texts, that training takes at most: those with the least hash of their doc_id, a bound
#: on the driver's memory.
MAX_TRAINING_ROWS = 5000
MAX_TRAINING_BYTES = 128 << 20
BUCKETS = 1 << 17
DIM = 4
NGRAMS = (3, 5)
THRESHOLD = 0.3
#: Words with a zero vector that every text has besides its own, so that a few odd words do not decide a short one.
NULL_WORDS = 10
#: Words of fewer training texts teach nothing.
MIN_TEXTS = 3
#: Words whose logits a worker remembers.
MEMO = 300_000

_SPACE = bytes(0x20 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_SPACE).split()


def ngrams(word: bytes) -> np.ndarray:
    """Buckets of the word itself and of its character n-grams, with its ends marked."""
    import xxhash

    text = f"<{word.decode()}>"
    grams = {text} | {text[k : k + n] for n in range(NGRAMS[0], NGRAMS[1] + 1) for k in range(len(text) - n + 1)}
    return np.array([xxhash.xxh32_intdigest(g) % BUCKETS for g in sorted(grams)], np.int64)


@dataclass
class Model:
    scalars: np.ndarray  # of each bucket: its vector times the difference of the two outputs
    bias: float

    def __post_init__(self):
        self._memo: dict[bytes, float] = {}

    def word(self, w: bytes) -> float:
        x = self._memo.get(w)
        if x is None:
            x = float(self.scalars[ngrams(w)].mean())
            if len(self._memo) < MEMO:
                self._memo[w] = x
        return x

    def score(self, raw: bytes | None) -> float:
        words = sorted(set(words_of(raw or b"")))  # sorted: the sum's last bits must not depend on the order
        z = self.bias + sum(map(self.word, words)) / (len(words) + NULL_WORDS)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


class _Held:
    """Held-back texts: their mean n-gram numbers under a table of scalars."""

    def __init__(self, texts: list[bytes]):
        number: dict[bytes, int] = {}
        bags = [[number.setdefault(w, len(number)) for w in sorted(set(words_of(t)))] for t in texts]
        grams = [ngrams(w) for w in number] or [np.zeros(1, np.int64)]
        self._gram, self._size = np.concatenate(grams), np.array([len(g) for g in grams])
        self._word, self._text = np.concatenate([np.array(b, np.int64) for b in bags]), np.repeat(np.arange(len(bags)), [len(b) for b in bags])
        self._n = np.array([len(b) + NULL_WORDS for b in bags])

    def means(self, scalars: np.ndarray) -> np.ndarray:
        word = np.add.reduceat(scalars[self._gram], np.concatenate([[0], np.cumsum(self._size)[:-1]])) / self._size
        return np.bincount(self._text, word[self._word], len(self._n)) / self._n


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope and shift of the logits that fit held-back labels best (Newton, a weak prior on slope 1), and their loss."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + (a - 1), (p - y).sum() + 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * z * z).sum() + 1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
    p = np.clip(1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))), 1e-9, 1 - 1e-9)
    return a, b, float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def train(texts: list[bytes], labels: list[int], epochs: int = 14, rate: float = 2.0, seed: int = 7) -> Model:
    """Adagrad on softmax cross-entropy, over vectors and outputs jointly; constant where there is nothing to learn.

    Every fifth text is held back: it chooses the epoch to keep and calibrates the scores.
    """
    back = np.arange(len(texts)) % 5 == 4
    held, held_y = _Held([t for t, x in zip(texts, back) if x] or [b""]), np.array([v for v, x in zip(labels, back) if x] or [0], np.float64)
    texts, labels = [t for t, x in zip(texts, back) if not x], [v for v, x in zip(labels, back) if not x]
    best: tuple[float, Model] | None = None
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    # the corpus as sparse matrices: text x word counts and word x n-gram weights
    number: dict[bytes, int] = {}
    cols, vals = [], []
    seen: dict[bytes, int] = {}
    bags = [sorted(set(words_of(raw))) for raw in texts]
    for bag in bags:
        for w in bag:
            seen[w] = seen.get(w, 0) + 1
    for bag in bags:
        size = len(bag) + NULL_WORDS
        bag = [w for w in bag if seen[w] >= MIN_TEXTS]
        ids = np.array([number.setdefault(w, len(number)) for w in bag], np.int64)
        cols.append(ids)
        vals.append(np.full(len(ids), 1 / size))
    if not number:
        return Model(np.zeros(BUCKETS), float(np.log(y.mean() / (1 - y.mean()))))
    grams = [ngrams(w) for w in number]
    size = np.array([len(g) for g in grams])
    gram = np.concatenate(grams)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    out = rng.uniform(-0.1, 0.1, (DIM, 2))
    bias = np.array([np.log(1 - y.mean()), np.log(y.mean())])
    seen_t, seen_o, seen_b = np.full((BUCKETS, 1), 1e-8), np.full(out.shape, 1e-8), np.full(2, 1e-8)
    step = 256
    order = np.arange(len(texts))
    lengths = np.array([len(c) for c in cols])
    used = np.unique(gram)
    for _ in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), step):
            own = order[at : at + step]
            c, v = np.concatenate([cols[t] for t in own]), np.concatenate([vals[t] for t in own])
            r = np.repeat(np.arange(len(own)), lengths[own])
            w, inverse = np.unique(c, return_inverse=True)
            # n-grams of the batch's words
            spread = np.concatenate([np.arange(f, f + n) for f, n in zip(first[w], size[w])]) if len(w) else np.zeros(0, np.int64)
            of = np.repeat(np.arange(len(w)), size[w])
            word = np.stack([np.bincount(of, table[gram[spread], d], len(w)) for d in range(DIM)], 1) / size[w][:, None]
            mean = np.stack([np.bincount(r, v * word[inverse, d], len(own)) for d in range(DIM)], 1)
            z = mean @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - np.stack([1 - y[own], y[own]], 1)) / len(own)
            g_out, g_bias, g_mean = mean.T @ g, g.sum(0), g @ out.T
            g_word = np.stack([np.bincount(inverse, v * g_mean[r, d], len(w)) for d in range(DIM)], 1) / size[w][:, None]
            b = gram[spread]
            g_table = np.stack([np.bincount(b, g_word[of, d], BUCKETS) for d in range(DIM)], 1)
            seen_t[used] += (g_table[used] ** 2).mean(1, keepdims=True)
            seen_o += g_out**2
            seen_b += g_bias**2
            table[used] -= rate * g_table[used] / np.sqrt(seen_t[used])
            out -= rate * g_out / np.sqrt(seen_o)
            bias -= rate * g_bias / np.sqrt(seen_b)
        scalars, shift = table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])
        a, b, loss = _calibrated(held.means(scalars) + shift, held_y)
        if best is None or loss < best[0]:
            best = loss, Model(a * scalars, a * shift + b)
    return best[1]


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable=None, bound: int = MAX_TRAINING_ROWS, bytes_bound: int = MAX_TRAINING_BYTES) -> tuple[list[bytes], list[int]]:
    """Texts and labels to train on: at most ``bound`` rows and ``bytes_bound`` bytes, in order of the hash of their doc_id."""
    own = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__label"))
    if usable is not None:
        own = own.where(usable(F.col("__id")))
    own = own.orderBy(F.xxhash64("__id"), "__id", "__label").limit(bound)
    joined = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("__id")).select("text", "__label", F.xxhash64("doc_id").alias("h"))
    texts, labels_of, total = [], [], 0
    for r in joined.orderBy("h", "__label", "text").toLocalIterator():
        raw = (r.text or "").encode()
        total += len(raw)
        if total > bytes_bound and texts or len(texts) == bound:
            break
        texts.append(raw)
        labels_of.append(r["__label"])
    return texts, labels_of


def score(docs: DataFrame, model: Model, below: float | None = None) -> DataFrame:
    """docs with ``score`` (0 to 1) behind its other columns (one so named is replaced); one pass, no shuffle.

    With ``below``, docs instead: only the rows that score less, their columns unchanged. Null and empty texts get the
    model's prior, repeated rows equal scores, an empty table no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**17 numbers
    names = [c for c in docs.columns if below is not None or c != "score"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index("text")
    schema = rows.schema if below is not None else StructType([*rows.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            scores = [own.score(x) for x in b.column(at).cast(pa.large_binary()).to_pylist()]
            if below is None:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])
            else:
                yield b.filter(pa.array([x < below for x in scores], pa.bool_()))
        release()

    return rows.mapInArrow(run, schema)
