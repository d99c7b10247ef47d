"""Toxicity by maximum-scoring segments.

* A token's score is the log-odds of its use in toxic and in other documents, with Dirichlet priors in a chain: a word's prior
  is what its six-byte prefix shows, that prefix's is the five-byte one's, and so on to the overall share. Counts are kept in
  two hashed tables of fixed size; the smaller count of the two is taken. A word scores above zero once in a passage.
* One linear scan over a text's token scores finds all maximal-scoring segments (Ruzzo and Tompa).
* By extreme-value theory the best segment of a clean text of n tokens scores above x with probability 1 - exp(-K n exp(-lambda x)).
  lambda solves sum p_i exp(lambda s_i) = 1 over clean tokens, K is fitted to clean texts. Segments with a small expected number are
  passages; the strongest evidence and the number of passages are mapped to a probability by a logistic fit.

Of exact copies one is learned from. For calibration a document is scored by the counts of all others: its own are taken off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import held_out, prepare, removed, text_column, train_row, trimmed, written

#: Of each of the two tables.
BUCKETS = 1 << 21
PREFIXES = (6, 5, 4)
#: Counts and calibration use at most about so many labelled documents of each class, chosen by hash.
PER_CLASS = 20_000
#: Strength of a prior in documents; what a token costs a segment; the range of a token's score.
PRIOR, COST, LOW, HIGH = 2.0, 1.0, -2.0, 6.0
#: A fall of the sum that ends a passage.
CLOSED = 20.0
#: A segment expected less often than this in a clean text of its length is a passage.
SIGNIFICANT = 0.01
THRESHOLD = 0.3

_GAP = np.zeros(256, bool)
_GAP[:128] = True
_GAP[[*range(65, 91), *range(97, 123)]] = False


def token_buckets(column: pa.Array):
    """Yields (first row, rows' offsets into tokens, buckets of the tokens and of their prefixes), block by block. Tokens are runs of letters (and other non-ASCII), lower-cased."""
    data, offsets = K.text_buffer(pc.utf8_lower(column.cast(pa.large_string())))
    for start, stop in K.blocks(offsets):
        part = offsets[start : stop + 1]
        own = data[part[0] : part[-1]]
        s, e, at = K.word_spans(own, part - part[0], _GAP)
        hashes = K.span_hashes(own, s, e, PREFIXES) if len(s) else [np.zeros(0, K.U64)] * (1 + len(PREFIXES))
        yield start, at, [np.stack([(h >> K.U64(40)).astype(np.int64) & (BUCKETS - 1), BUCKETS + ((h >> K.U64(16)).astype(np.int64) & (BUCKETS - 1))]) for h in hashes]


def token_scores(buckets: list[np.ndarray], toxic: np.ndarray, clean: np.ndarray, share: float, own: np.ndarray | None = None) -> np.ndarray:
    """Scores of tokens; own: the label of each token's document, if that is among the counted."""
    prior = np.full(buckets[0].shape[1], share)
    for b in (*buckets[:0:-1], buckets[0]):  # from the shortest prefix to the word
        t, c = toxic[b].min(axis=0), clean[b].min(axis=0)
        if own is not None:
            t, c = np.maximum(t - own, 0), np.maximum(c - (1 - own), 0)
        t, c = t + PRIOR * prior, c + PRIOR * (1 - prior)
        prior = t / (t + c)
    odds = np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return np.clip(odds, LOW, HIGH) - COST


def first_uses(scores: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Scores of one text's tokens, with those above zero kept at a word's first use in a passage alone: a word said often is no more evidence.

    A passage is over where its sum has fallen to zero, or by CLOSED from its peak; after that all words count again.
    """
    up = np.flatnonzero(scores > 0)
    if len(up) < 2 or len(np.unique(words[up])) == len(up):
        return scores
    below = np.cumsum(np.minimum(scores, 0))[up]
    out, used = scores.copy(), set()
    run = peak = last = 0.0
    for k, word, value, b in zip(up.tolist(), words[up].tolist(), scores[up].tolist(), below.tolist()):
        run, last = max(0.0, run + b - last), b
        if run == 0 or peak - run > CLOSED:
            used.clear()
            peak = run
        if word in used:
            out[k] = value = -COST
        used.add(word)
        run += value
        peak = max(peak, run)
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) in linear time; runs of negative tokens are read as one."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    first = up[np.concatenate([[True], np.diff(up) > 1])]
    last = up[np.concatenate([np.diff(up) > 1, [True]])] + 1
    stack: list[list] = []  # start, end, sum before, sum to the end
    for a, b in zip(first.tolist(), last.tolist()):
        low, high = total[a], total[b]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                stack.append([a, b, low, high])
                break
            a, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, float(high - low)) for a, b, low, high in stack]


@dataclass
class Model:
    toxic: np.ndarray
    clean: np.ndarray
    share: float
    rate: float = 1.0
    log_k: float = 0.0
    weights: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def evidence(self, best: float, n: int, found) -> tuple[float, int]:
        """Minus the log of the expected number of such segments in a clean text of this length, and how many segments are significant."""
        if n == 0 or best <= 0:
            return 0.0, 0
        base = self.log_k + np.log(n)
        return float(np.clip(self.rate * best - base, 0, 30)), sum(self.rate * x[2] - base > -np.log(SIGNIFICANT) for x in found)

    def probability(self, value: float, passages: int) -> float:
        a, b, c = self.weights
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(value) + c * np.log1p(passages), -30, 30))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 2 * BUCKETS
    table = np.zeros((2, size), np.int32)
    for b in batches:
        kind = b.column(1).to_numpy()
        for start, at, buckets in token_buckets(b.column(0)):
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for x in buckets:
                if x.size:
                    own = np.unique((row * size + x).ravel())  # a document counts once
                    np.add.at(table, (kind[start + own // size], own % size), 1)
    at = np.flatnonzero(table.any(axis=0))
    for k in range(0, len(at), 100_000):
        own = at[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), *(pa.array(table[j, own]) for j in range(2))], names=["bucket", "clean", "toxic"])


def _evidence(counts):
    """A row a document of (best score, tokens, the segments' scores as bytes, label), each document's own counts taken off; and one a task, without a label, of its clean documents' histogram of token scores."""

    def run(batches):
        toxic, clean, share = counts.value
        edges = np.linspace(LOW - COST, HIGH - COST, 66)
        spread = np.zeros(65)
        for b in batches:
            label = b.column(1).to_numpy()
            best, n, marks = [], [], []
            for start, at, buckets in token_buckets(b.column(0)):
                scores = token_scores(buckets, toxic, clean, share, np.repeat(label[start : start + len(at) - 1], np.diff(at)))
                for r in range(len(at) - 1):
                    s = first_uses(scores[at[r] : at[r + 1]], buckets[0][1, at[r] : at[r + 1]])
                    found = segments(s)
                    best.append(max((x[2] for x in found), default=0.0))
                    n.append(len(s))
                    marks.append(np.array([x[2] for x in found], np.float32).tobytes())
                    if label[start + r] == 0:
                        spread += np.histogram(s, edges)[0]
            yield pa.RecordBatch.from_arrays([pa.array(best, pa.float64()), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), b.column(1)], names=["best", "n", "marks", "toxic"])
        yield pa.RecordBatch.from_arrays([pa.array([0.0]), pa.array([0], pa.int64()), pa.array([spread.tobytes()], pa.binary()), pa.nulls(1, pa.int32())], names=["best", "n", "marks", "toxic"])

    return trimmed(run)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = np.full(x.shape[1], ridge)
        r[0] = 1e-3
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(r), x.T @ (y - p) - r * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learns from labelled documents that are not held out."""
    spark = documents.sparkSession
    marks = labels.where(train_row() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where("toxic in (0, 1)")
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        p = 0.99 if sizes.get(1) else 0.01
        return Model(np.zeros(2 * BUCKETS, np.float32), np.zeros(2 * BUCKETS, np.float32), 0.5, weights=(float(np.log(p / (1 - p))), 0.0, 0.0))
    part = F.when(F.col("toxic") == 1, min(1.0, PER_CLASS / sizes[1])).otherwise(min(1.0, PER_CLASS / sizes[0]))
    key = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 30))
    sample = marks.where(key < part * (1 << 30)).select("doc_id", "toxic").orderBy(key, "doc_id").limit(3 * PER_CLASS)
    text = documents.select("doc_id", text_column(documents).alias("text"))
    ids = text.select("doc_id", F.xxhash64("text").alias("hash")).join(F.broadcast(sample), "doc_id").groupBy("hash", "toxic").agg(F.min("doc_id").alias("doc_id"))
    ids = written(ids.select("doc_id", "toxic").distinct(), "sample")
    rows = text.join(F.broadcast(ids), "doc_id").select("text", "toxic")
    drawn = {r.toxic: r.n for r in ids.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = {y: max(1, drawn.get(y, 0)) for y in (0, 1)}
    counts = rows.mapInArrow(_count, "bucket int, clean int, toxic int").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    table = np.zeros((2, 2 * BUCKETS), np.float32)
    for k, c in enumerate(("clean", "toxic")):
        table[k, counts["bucket"].to_numpy()] = counts[c].to_numpy()
    # Documents count, so the share of a word that tells nothing is that of toxic documents.
    share = drawn[1] / (drawn[0] + drawn[1])
    seen = rows.mapInArrow(_evidence(spark.sparkContext.broadcast((table[1], table[0], share))), "best double, n long, marks binary, toxic int").toArrow()
    labelled = seen["toxic"].is_valid()
    spread = sum((np.frombuffer(x.as_buffer(), np.float64) for x in seen.filter(pc.invert(labelled))["marks"]), np.zeros(65))
    seen = seen.filter(labelled)
    best, n, toxic = (seen[c].to_numpy() for c in ("best", "n", "toxic"))
    marks_of = [np.frombuffer(x.as_buffer(), np.float32) for x in seen["marks"]]
    model = Model(table[1], table[0], share)
    clean = np.flatnonzero(toxic == 0)
    middle = np.linspace(LOW - COST, HIGH - COST, 66)
    middle = (middle[1:] + middle[:-1]) / 2
    p = spread / max(1.0, spread.sum())
    rates = np.geomspace(0.05, 3, 200)
    over = [r for r in rates if (p * np.exp(np.clip(r * middle, -50, 50))).sum() >= 1]
    model.rate = float(over[0] if over else rates[-1])
    fair = clean[n[clean] > 0]
    # Of clean texts, a share 1 - exp(-K n exp(-rate x)) scores above x: K by maximum likelihood given the rate.
    model.log_k = float(-np.log(np.mean(n[fair] * np.exp(-model.rate * np.maximum(best[fair], 0))))) if len(fair) else 0.0
    x = np.array([[np.log1p(v), np.log1p(k)] for v, k in (model.evidence(best[i], n[i], [(0, 0, s) for s in marks_of[i]]) for i in range(len(best)))])
    # The sample may hold a smaller share of the clean ones than the table; weigh the intercept back.
    w = _logistic(x, toxic.astype(float))
    w[0] += np.log(sizes[1] / drawn[1]) - np.log(sizes[0] / drawn[0])
    model.weights = tuple(float(v) for v in w)
    removed(spark, ids)
    return model


def score(documents: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score, n_tokens and passages: an array of (start, end, score) in tokens, significant ones only."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own = documents.select(text_column(documents).alias("__text"), *keep)
    kind = "array<struct<start: long, end: long, score: double>>"
    schema = own.select(*keep, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast(kind).alias("passages")).schema
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        m = shared.value
        for b in batches:
            p, n, spans = [], [], []
            for _, at, buckets in token_buckets(b.column(0)):
                s = token_scores(buckets, m.toxic, m.clean, m.share)
                for r in range(len(at) - 1):
                    found = segments(first_uses(s[at[r] : at[r + 1]], buckets[0][1, at[r] : at[r + 1]]))
                    k = int(at[r + 1] - at[r])
                    value, passages = m.evidence(max((x[2] for x in found), default=0.0), k, found)
                    base = m.log_k + np.log(max(1, k))
                    p.append(m.probability(value, passages))
                    n.append(k)
                    spans.append([{"start": a, "end": e, "score": v} for a, e, v in found if m.rate * v - base > -np.log(SIGNIFICANT)])
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(p, pa.float64()), pa.array(n, pa.int64()), pa.array(spans, passage)], names=[*keep, "score", "n_tokens", "passages"])

    return own.mapInArrow(trimmed(run), schema)


def toxicity_table(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and the number of toxic passages of every row.

    A null or empty text has no evidence and the score of that. A null doc_id is neither learned from nor held out; null labels
    are ignored and of repeated ones the largest counts. Without labels of both classes all scores are alike. An empty table
    gives an empty table; extra columns are ignored.
    """
    prepare(documents.sparkSession)
    out = score(documents.select("doc_id", "text"), fit(documents, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
