"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is one space, and n-grams of one to three characters are hashed to a fixed number of
features. Document frequencies come from all labelled rows that may be learned from; the weights from a bounded, hash-chosen
sample of them, by follow-the-regularised-leader with elastic-net penalties; a temperature fitted on a part kept aside
calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, prepare, removed, text_column, train_row, trimmed, written

FEATURES = 1 << 16
ORDERS = (1, 2, 3)
#: The weights are fitted on about so many rows of a language, fewer if that is more than SAMPLE in all, but never fewer than LEAST.
PER_LANGUAGE, SAMPLE, LEAST = 1000, 10_000, 20
#: Every label is learned; with many of them features are folded so that there are at most so many weights.
MOST_WEIGHTS = 1 << 23
#: Labels whose shares are broadcast; those of more are joined.
MOST_BROADCAST = 100_000
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and counts of a text; none if it has no letter."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = _letter_table()[c]
    if not keep.any():
        return none
    c = np.where(keep, c, 32).astype(np.uint64)
    keep[1:] |= keep[:-1].copy()  # one space after a letter
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint64)
    found = []
    h = np.full(len(c), 1, np.uint64)
    for k in range(min(ORDERS[-1], len(c))):  # an n-gram's hash goes on from that of its first n - 1 characters
        h = (h[: len(c) - k] ^ c[k:]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        found.append((h >> np.uint64(20)) & np.uint64(FEATURES - 1))
    h = np.concatenate(found).astype(np.int64)
    if len(h) > 4000:
        counts = np.bincount(h, minlength=FEATURES)
        ids = np.flatnonzero(counts)
        return ids, counts[ids]
    return np.unique(h, return_counts=True)


def folded(ids: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Features modulo a power of two, counts added up."""
    if width >= FEATURES:
        return ids, counts
    own, at = np.unique(ids & (width - 1), return_inverse=True)
    return own, np.bincount(at, counts).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features + 1 (bias) by languages
    temperature: float = 1.0

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[ids]
        return x / max(1e-12, np.sqrt((x * x).sum()))

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(ids, counts) @ self.weights[ids] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        ids, counts = folded(*features(text), len(self.idf))
        if not len(ids) or not self.languages:
            return UNKNOWN, 0.0
        p = _softmax(self.logits(ids, counts) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def fit_weights(rows: list[tuple[int, np.ndarray, np.ndarray]], model: Model, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-3, seed: int = 7) -> None:
    """FTRL-proximal over rows of (class, ids, counts); sets the model's weights and temperature."""
    k, width = len(model.languages), len(model.idf)
    z, n = np.zeros((width + 1, k)), np.zeros((width + 1, k))
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(rows))
    aside, used = order[: len(order) // 5], order[len(order) // 5 :]
    ready = [(y, np.append(ids, width).astype(np.int32), np.append(model.vector(ids, counts), 1.0).astype(np.float32)) for y, ids, counts in rows]
    for _ in range(epochs):
        for r in draw.permutation(used):
            y, at, x = ready[r]
            zs, ns = z[at], n[at]
            root = np.sqrt(ns)
            w = np.where(np.abs(zs) > l1, -(zs - np.sign(zs) * l1) / ((beta + root) / alpha + l2), 0.0)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[at] = zs + g - (np.sqrt(ns + g * g) - root) / alpha * w
            n[at] = ns + g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    model.weights = w.astype(np.float32)
    held = [(ready[r][0], ready[r][2] @ w[ready[r][1]]) for r in (aside if len(aside) else used)]

    def loss(t: float) -> float:
        return -sum(np.log(max(1e-12, _softmax(x / t)[y])) for y, x in held)

    if held:
        model.temperature = float(min(np.geomspace(0.05, 4, 45), key=loss))


_FITTED = pa.schema([("feature", pa.int32()), ("df", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("counts", pa.binary())])


@trimmed
def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(FEATURES, np.int64)
    for b in batches:
        lang, ids_out, counts_out = [], [], []
        for text, label, chosen in zip(*(c.to_pylist() for c in b.columns)):
            ids, counts = features(text)
            df[ids] += 1
            if chosen and len(ids):
                lang.append(label)
                ids_out.append(ids.astype(np.uint32).tobytes())
                counts_out.append(counts.astype(np.uint32).tobytes())
        if lang:
            k = len(lang)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(lang), pa.array(ids_out, pa.binary()), pa.array(counts_out, pa.binary())], schema=_FITTED)
    at = np.flatnonzero(df)
    if len(at):
        k = len(at)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at]), pa.nulls(k, pa.string()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=_FITTED)


def fit(documents: DataFrame) -> Model:
    """Learns from text and non-null lang of the rows that are not held out; every label is learned. The driver holds one count a label and the sample."""
    spark = documents.sparkSession
    rows = documents.where(train_row() & F.col("lang").isNotNull()).select(F.col("doc_id"), text_column(documents).alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    most = max(LEAST, min(PER_LANGUAGE, SAMPLE // max(1, len(sizes))))
    shares = spark.createDataFrame([(r.lang, min(1.0, most / r.n)) for r in sizes], "lang string, share double")
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    # Of known size: one row a label.
    gathered = written(rows.join(F.broadcast(shares) if len(sizes) <= MOST_BROADCAST else shares, "lang").select("text", "lang", chosen.alias("chosen")).mapInArrow(_gather, "feature int, df long, lang string, ids binary, counts binary"), "language")
    width = FEATURES
    while width * len(sizes) > MOST_WEIGHTS and width > 256:
        width //= 2
    total = sum(r.n for r in sizes)
    counts = gathered.where("feature is not null").groupBy("feature").agg(F.sum("df").alias("df")).toArrow()
    df = np.bincount(counts["feature"].to_numpy() & (width - 1), counts["df"].to_numpy(), width)
    model = Model([r.lang for r in sizes], np.log((1 + total) / (1 + np.minimum(df, total))) + 1, np.zeros((width + 1, max(1, len(sizes))), np.float32))
    code = {x: k for k, x in enumerate(model.languages)}
    sample = gathered.where("lang is not null").orderBy(F.xxhash64("lang", "ids", "counts")).toArrow()
    data = [(code[x.as_py()], *folded(np.frombuffer(i.as_buffer(), np.uint32), np.frombuffer(c.as_buffer(), np.uint32), width)) for x, i, c in zip(sample["lang"], sample["ids"], sample["counts"])]
    removed(spark, gathered)
    if data:
        fit_weights(data, model)
    return model


def identify(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score. A null or empty text, or one without a letter, is `und` with score 0. Repeated rows get a row each, nulls in the kept columns stay, an empty table gives an empty table."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own = documents.select(text_column(documents).alias("__text"), *keep)
    schema = own.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return own.mapInArrow(trimmed(run), schema)


def language_table(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    A null doc_id is neither learned from nor held out. Repeated rows get a row each. With nothing to learn from every row is
    `und`. An empty table gives an empty table; extra columns are ignored.
    """
    prepare(documents.sparkSession)
    return identify(documents.select("doc_id", "text"), fit(documents)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
