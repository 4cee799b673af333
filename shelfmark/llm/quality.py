"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

Features are a text's words and what they are made of besides letters: case, trailing punctuation, bare symbols, and
repeated lines. A bounded sample of labelled rows, SAMPLE for each label, gives inverse document frequencies, a randomised
SVD and the labelled vectors, so what is broadcast has a fixed size bound. Every document is projected, its cosine with
every labelled vector computed exactly in blocks, and the NEIGHBOURS nearest vote with their similarity as weight.

Defined results: null text counts as empty; a text with no features, or no neighbour of positive similarity, gets the share
of label 1 in the sample; labelled rows as similar as the last neighbour vote too; an id with several labels counts with the least;
rows are kept, repeated or not; where no labelled row exists every score is 0.5; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.frames import if_small, map_arrow, small_batches, two_columns, worker_slot
from shelfmark.llm.language_id import by_share, sample
from shelfmark.llm.words import WordRows
from shelfmark.session import cut

#: Labelled rows for each label, hashed features, latent dimensions, and neighbours that vote.
SAMPLE, FEATURES, RANK, NEIGHBOURS = 1500, 1 << 14, 32, 25
#: Distinct words whose vectors a Python worker keeps, and texts whose products with the labelled vectors are made at once.
WORDS_KEPT, BLOCK = 60_000, 500
#: How much more the make-up of words counts than the words.
SHAPE_WEIGHT = 3.0

EDGES = re.compile(r"^([^\w\s]*)(.*?)([^\w\s]*)$", re.S)


def hashed(feature: str) -> int:
    return zlib.crc32(feature.encode()) % FEATURES


@lru_cache(1 << 16)
def shape_features(shape: str, before: str, after: str, length: int) -> tuple[int, ...]:
    names = (f"s {shape}", f"a {after[-2:]}", f"b {before[:2]}", f"x {shape} {bool(before)} {min(len(after), 3)}", f"k {length}")
    return tuple(map(hashed, names))


def word_features(word: str) -> tuple[tuple[int, ...], int]:
    """The features of what a piece between white space is made of, and that of its word, or -1."""
    before, core, after = ("", word, "") if word.isalpha() else EDGES.match(word).groups()
    shape = "n" if not core else "d" if core.isdigit() else "U" if core.isupper() and len(core) > 1 else "u" if core[0].isupper() else "l" if core.isalpha() else "m"
    return shape_features(shape, before[:3], after[-3:], min(len(core), 12) // 3), hashed(f"w {core.lower()}") if core.isalpha() else -1


def line_features(text: str, n: int, again: int) -> list[tuple[str, float]]:
    """Features of the whole text: of its n words those that repeat the one before; lines that repeat another, or end like sentences."""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return []
    repeated = 1 - len(set(lines)) / len(lines)
    ended = sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines)
    return [("w again", again * 5.0), ("w other", float(n - again)), ("l repeated", repeated * len(lines) * 10.0), ("l ended", ended * len(lines)), ("l open", (1 - ended) * len(lines))]


@dataclass
class Model:
    """idf x right singular vectors; unit vectors of the labelled rows, and their labels."""

    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def words(self, new: list[str]) -> tuple[np.ndarray]:
        """Vectors of pieces between white space."""
        found = [word_features(w) for w in new]
        shapes = np.array([f[0] for f in found])
        words = np.array([f[1] for f in found])
        rows = SHAPE_WEIGHT * self.project[shapes].sum(axis=1)
        rows[words >= 0] += self.project[words[words >= 0]]
        return (rows,)

    def latent(self, texts: list[str]) -> np.ndarray:
        """A vector for each whole text, of length 1 or 0."""
        split, arrays = worker_slot(("quality", self.key), lambda: WordRows(self.words, WORDS_KEPT)).batch([t.split() for t in texts])
        out = np.zeros((len(texts), self.project.shape[1]), np.float32)
        for k, (rows, text) in enumerate(zip(split, texts, strict=True)):
            if len(rows):
                out[k] = arrays[0][rows].sum(axis=0)
                for name, w in line_features(text, len(rows), int((rows[1:] == rows[:-1]).sum())):
                    out[k] += w * self.project[hashed(name)]
        return unit(out)

    def score(self, texts: list[str]) -> np.ndarray:
        """The votes for label 1 among each text's neighbours, weighted by similarity."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        out = np.empty(len(texts))
        for at in range(0, len(texts), BLOCK):
            near = self.latent(texts[at : at + BLOCK]) @ self.vectors.T
            out[at : at + BLOCK] = votes(near, self.labels)
        return out


def votes(near: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Share of label 1 among the NEIGHBOURS of greatest similarity in each row, each with its similarity as weight.

    All that are as similar as the last of them vote too, so the order of the labelled rows is of no account.
    """
    k = min(NEIGHBOURS, near.shape[1])
    least = np.maximum(np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k], 0.0)
    weight = np.where(near >= least[:, None], np.maximum(near, 0.0), 0.0).astype(np.float64)
    total = weight.sum(axis=1)
    return np.where(total > 0, (weight @ labels) / np.where(total > 0, total, 1), labels.mean())


def unit(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def features_of(text: str) -> tuple[list[int], list[float]]:
    found: Counter = Counter()
    words = text.split()
    for word, n in Counter(words).items():
        shape, own = word_features(word)
        for f in shape:
            found[f] += n * SHAPE_WEIGHT
        if own >= 0:
            found[own] += n
    for name, w in line_features(text, len(words), sum(map(str.__eq__, words, words[1:]))) if found else []:
        found[hashed(name)] += w
    return list(found), [float(x) for x in found.values()]


@dataclass
class Sparse:
    """A matrix of few values: for each, in order of rows, its row, column and value."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    shape: tuple[int, int]

    def times(self, x: np.ndarray) -> np.ndarray:
        return self._sums(self.rows, self.columns, self.values, x, self.shape[0])

    def transposed_times(self, x: np.ndarray) -> np.ndarray:
        order = np.argsort(self.columns, kind="stable")
        return self._sums(self.columns[order], self.rows[order], self.values[order], x, self.shape[1])

    @staticmethod
    def _sums(to: np.ndarray, of: np.ndarray, values: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Row sums in pieces, so that memory stays that of some thousand rows of x."""
        out = np.zeros((n, x.shape[1]), np.float32)
        for at in range(0, len(to), 1 << 14):
            own = to[at : at + (1 << 14)]
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[begin]] += np.add.reduceat(x[of[at : at + (1 << 14)]] * values[at : at + (1 << 14), None], begin)
        return out


def randomised_svd(a: Sparse, rank: int, rounds: int = 2) -> np.ndarray:
    """Right singular vectors (columns) of a for its largest singular values."""
    width = min(rank + 10, *a.shape)
    q = np.linalg.qr(a.times(np.random.default_rng(0).standard_normal((a.shape[1], width), dtype=np.float32)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(a.times(np.linalg.qr(a.transposed_times(q))[0]))[0]
    return np.linalg.svd(a.transposed_times(q), full_matrices=False)[0][:, :rank]


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on a bounded sample of the usable labelled rows; rows with a null label count as unlabelled."""
    small_batches(docs.sparkSession)
    known = labels.filter(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("group")).groupBy("id").agg(F.min("group").alias("group"))
    # Some thousand ids; their rows are drawn again by text, since an id may have many.
    drawn = if_small(cut(by_share(known, F.xxhash64(F.lit("labels"), "id"), 2 * SAMPLE).select("id", "group")))
    rows = sample(two_columns(docs, id_col, text_col).join(drawn, "id"), SAMPLE).select("text", F.col("group").alias("label"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pairs = [features_of(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1] for p in pairs], pa.list_(pa.float32())), batch.column(1)], ["f", "w", "label"])

    # At most SAMPLE rows of each label, each of at most FEATURES values.
    found = map_arrow(rows, each, "f array<int>, w array<float>, label int").toArrow()
    found = found.filter(pc.greater(pc.list_value_length(found["f"]), 0)).combine_chunks()
    n = found.num_rows
    if not n:
        return Model(np.zeros((FEATURES, RANK), np.float32), np.zeros((0, RANK), np.float32), np.zeros(0))
    of_row = np.repeat(np.arange(n), pc.list_value_length(found["f"]).to_numpy())
    f, w = (pc.list_flatten(found[c]).to_numpy() for c in ("f", "w"))
    idf = np.log((1 + n) / (1 + np.bincount(f, minlength=FEATURES))).astype(np.float32) + np.float32(0.1)
    w = w * idf[f]
    length = np.sqrt(np.bincount(of_row, w.astype(np.float64) ** 2, n)).astype(np.float32)
    right = randomised_svd(Sparse(of_row, f, w / length[of_row], (n, FEATURES)), RANK)
    project = np.zeros((FEATURES, RANK), np.float32)
    project[:, : right.shape[1]] = idf[:, None] * right
    vectors = unit(Sparse(of_row, f, w / idf[f], (n, FEATURES)).times(project))
    return Model(project, vectors, found["label"].to_numpy().astype(np.float64))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to its score; the model, of bounded size, is broadcast."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def predict(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(texts.to_pylist()).astype(np.float64))

    return predict


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    return two_columns(docs, id_col, text_col).select(F.col("id").alias(id_col), scorer(docs.sparkSession, model)(F.col("text")).alias("score"))
