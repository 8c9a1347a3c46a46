"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

Texts become hashed words, word shapes and text statistics; a truncated SVD of a
bounded labelled sample gives the latent space. The sample's vectors and labels (a
fixed size) are broadcast; every document's exact cosines to all of them are taken in
blocks, and the labels of the nearest are weighted by similarity.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, slices

#: Bound of the labelled sample that is fitted and broadcast.
SAMPLE_ROWS = 4096
DIMENSIONS = 64
NEIGHBOURS = 25
WORD_BITS, SHAPE_BITS = 12, 9
BINS = 8
WINDOW = 400
_SYMBOL = re.compile(r"([^\w\s])\1*")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
#: Statistics of a text: the upper end of each one's scale.
SCALES = {"repeat": 0.5, "distinct": 1.0, "symbols": 0.3, "alone": 0.3, "length": 12.0, "digits": 0.2, "upper": 0.3, "lines": 0.1, "second": 0.5, "size": 10.0}
N_WORDS, N_SHAPES, N_STATS = 1 << WORD_BITS, 1 << SHAPE_BITS, len(SCALES) * BINS
WIDTH = N_WORDS + N_SHAPES + N_STATS


_PLAIN = xxhash.xxh32_intdigest(b"a", 1) & (N_SHAPES - 1)


def _counts(token: str) -> tuple[int, int]:
    """Digits and symbols of a token."""
    return sum(c.isdigit() for c in token), sum(len(m[0]) for m in _SYMBOL.finditer(token))


class _Tokens(dict):
    """token -> word hash, shape hash, counts of digits and symbols (255: to be counted again), flags packed in one integer."""

    def __missing__(self, token):
        if len(self) > 1 << 16:
            self.clear()
        if token.isalpha():
            low = xxhash.xxh32_intdigest(token.lower().encode("utf-8", "surrogatepass")) & (N_WORDS - 1)
            self[token] = value = low | _PLAIN << 12 | token[:1].isupper() << 41
            return value
        word = _SYMBOL.sub("", token).lower()
        shape = _SYMBOL.sub(r"\1", _DIGITS.sub("0", _LETTERS.sub("a", token)))
        runs = max((len(m[0]) for m in _SYMBOL.finditer(token)), default=0)
        shape += f"~{runs.bit_length()}" if runs > 1 else ""
        low = xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) & (N_WORDS - 1)
        high = xxhash.xxh32_intdigest(shape.encode("utf-8", "surrogatepass"), 1) & (N_SHAPES - 1)
        digits, symbols = (min(x, 255) for x in _counts(token))
        self[token] = value = low | high << 12 | digits << 24 | symbols << 32 | (not word) << 40 | token[:1].isupper() << 41
        return value


_tokens = _Tokens()


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text: indices and weights, each block of unit length."""
    text = text or ""
    words = text.split()
    n = len(words)
    at, w = [], []
    stats = np.zeros(len(SCALES))
    if n:
        packed = np.fromiter(map(_tokens.__getitem__, words), np.int64, n)
        for ids, base in ((packed & (N_WORDS - 1), 0), (packed >> 12 & (N_SHAPES - 1), N_WORDS)):
            count = np.bincount(ids)
            some = np.flatnonzero(count)
            weight = np.log1p(count[some])
            at.append(some + base)
            w.append(weight / np.sqrt((weight**2).sum()))
        whole = packed & (1 << 24) - 1
        chars = len(text)
        digits, symbols = packed >> 24 & 255, packed >> 32 & 255
        for i in np.flatnonzero((digits == 255) | (symbols == 255)):
            digits[i], symbols[i] = _counts(words[i])
        # Distinct words of each run of 400: comparable across lengths.
        runs = np.arange(n, dtype=np.int64) // WINDOW << 24 | whole
        stats[:] = (
            np.count_nonzero(whole[1:] == whole[:-1]) / n,
            len(np.unique(runs)) / n,
            symbols.sum() / chars,
            (packed >> 40 & 1).sum() / n,
            chars / n,
            digits.sum() / chars,
            (packed >> 41 & 1).sum() / n,
            text.count("\n") / n,
            np.count_nonzero(whole[2:] == whole[:-2]) / n,
            np.log1p(n),
        )
    # Each statistic is shared by its two nearest bins.
    x = np.clip(stats / np.array(list(SCALES.values())), 0, 1) ** 0.5 * (BINS - 1)
    low = np.minimum(x.astype(int), BINS - 2)
    part = x - low
    base = N_WORDS + N_SHAPES + np.arange(len(SCALES)) * BINS
    at += [base + low, base + low + 1]
    w += [(1 - part) / np.sqrt(len(SCALES)), part / np.sqrt(len(SCALES))]
    return np.concatenate(at), np.concatenate(w).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int

    def latent(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.empty((len(rows), self.axes.shape[1]), np.float32)
        for i, (at, w) in enumerate(rows):
            out[i] = (w * self.idf[at]) @ self.axes[at]
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], block: int = 256) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors.

        Cosines are rounded far below their meaning, so that a text's score doesn't depend on
        the texts beside it; all neighbours as near as the last one take part.
        """
        if not len(self.labels):
            return np.full(len(rows), 0.5)
        x = self.latent(rows).astype(np.float64)
        others = self.vectors.astype(np.float64).T
        k = min(self.neighbours, len(self.labels))
        out = np.empty(len(x))
        for i in range(0, len(x), block):
            cosine = np.round(x[i : i + block] @ others, 9)
            last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1]
            row, col = np.nonzero(cosine >= last[:, None])
            best = cosine[row, col]
            # Similarity falls off from the nearest neighbour's.
            weight = np.exp(20.0 * (best - cosine.max(axis=1)[row])) * np.clip(best, 1e-3, None)
            n = len(cosine)
            out[i : i + block] = np.bincount(row, weight * self.labels[col], n) / np.bincount(row, weight, n)
        return np.clip(out, 0.0, 1.0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """Latent space and vectors of the sample; no rows give a model that scores 0.5."""
    n = len(rows)
    idf = np.ones(WIDTH, np.float32)
    x = np.zeros((n, WIDTH), np.float32)
    for i, (at, w) in enumerate(rows):
        x[i, at] = w
    if n:
        seen = (x[:, : N_WORDS + N_SHAPES] > 0).sum(axis=0)
        idf[: N_WORDS + N_SHAPES] = np.log((1 + n) / (1 + seen)) / np.log(1 + n)
        idf[:N_WORDS] *= 0.5
        x *= idf
    rng = np.random.default_rng(7)
    q = rng.standard_normal((WIDTH, min(dimensions + 16, max(n, 1)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q) if n else q)
    _, s, axes = np.linalg.svd(x @ q, full_matrices=False)
    axes = (q @ axes.T)[:, :dimensions].astype(np.float32) if n else q[:, :dimensions]
    model = Model(idf, axes, np.zeros((0, axes.shape[1]), np.float32), np.asarray(labels, np.float64), neighbours)
    model.vectors = model.latent(rows)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most `sample_rows` labelled documents, chosen by a hash of their ids.

    Labels other than 0 and 1 and null ids are left out; an id labelled twice takes the
    larger label, an id of several documents its smallest text. Null and empty texts are
    texts without words; whole texts of any length are read. Without labelled documents
    every score is 0.5. At most `sample_rows` rows are collected, whatever repeats.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                made = [features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").cast(pa.string()), part.column("label").cast(pa.int32()), pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([w for _, w in made], pa.list_(pa.float32()))],
                    names=["id", "label", "at", "w"],
                )

    table = rows.mapInArrow(run, "id string, label int, at array<int>, w array<float>").toArrow().sort_by("id")
    labels_of = table.column("label").to_pylist()
    # Views of two flat arrays: lists of Python numbers would take twenty times as much.
    columns = [pa.concat_arrays(table.column(k).chunks or [pa.array([], pa.list_(pa.int32()))]) for k in ("at", "w")]
    flat, bounds = [c.flatten().to_numpy() for c in columns], [c.value_lengths().to_numpy().cumsum() for c in columns]
    rows = [(flat[0][p:q], flat[1][r:s]) for p, q, r, s in zip([0, *bounds[0][:-1]], bounds[0], [0, *bounds[1][:-1]], bounds[1])]
    model = fit(rows, labels_of)
    settle()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Every row's id (and the columns in `keep`), `score` from 0 to 1 and `predicted`.

    Null and empty texts are scored as texts without words; whole texts are read
    whatever their length; repeated rows score alike; an empty table gives an empty
    result; columns that aren't asked for are ignored, and any names can be asked for.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *[docs[c].alias(f"keep_{i}") for i, c in enumerate(keep)])
    kinds = dict(chosen.dtypes)
    names = ["id", *[f"keep_{i}" for i in range(len(keep))]]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                value = held.value.score([features(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    out = chosen.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, predicted int")
    return out.select(F.col("id").alias(id_col), *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)], "score", "predicted")
