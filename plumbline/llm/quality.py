"""Operator 3: a quality classifier of naive Bayes features and a linear support vector machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .common import settled, unique_name

FEATURE_BITS = 18
SAMPLE = 12_000  # labelled documents to learn from, at most
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
THRESHOLD = -0.05  # a little below 0, since a good document lost costs more than a bad one kept
SEED = 3


def ngrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashed unigrams and bigrams of tokens of each text, one for a token thrice in a row, and offsets of each text's."""
    w = textops.tokens(texts)
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(bits)
    low = np.uint64((1 << bits) - 1)
    one = owner | (w.hash >> np.uint64(1)) & low
    two = textops.fold(w.hash, 2)
    inside = owner[1:] == owner[:-1]
    # a trigram of one repeated token is one feature, whichever token it is
    same = (w.hash[2:] == w.hash[1:-1]) & (w.hash[1:-1] == w.hash[:-2]) & (owner[2:] == owner[:-2])
    both = np.unique(np.concatenate([one, (owner[1:] | two & low)[inside], owner[2:][same]]))
    offsets = np.searchsorted(both, np.arange(len(counts) + 1, dtype=np.uint64) << np.uint64(bits))
    return (both & low).astype(np.int32), offsets


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, smoothing: float) -> np.ndarray:
    """log of each feature's share of the positive rows' indicators over its share of the negative rows'."""
    p, q = np.full(size, smoothing), np.full(size, smoothing)
    for x, label in zip(rows, y):
        (p if label > 0 else q)[x] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model of rows scaled to unit length.

    Each class has the same total cost.  A step sets one row's dual variable
    to its best value, between 0 and its cost, and moves the weights with it.
    """
    # the bias is the weight of a constant feature of 1
    norms = np.array([np.sqrt((scale[x] ** 2).sum()) or 1.0 for x in rows])
    values = [scale[x] / n for x, n in zip(rows, norms)]
    square = np.array([(v * v).sum() + 1.0 for v in values])
    positive = (y > 0).sum()
    limit = np.where(y > 0, len(y) / (2 * positive), len(y) / (2 * (len(y) - positive))) * cost
    weights, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            x, v = rows[i], values[i]
            slope = y[i] * (weights[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weights[x] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, bits: int = FEATURE_BITS, sample: int = SAMPLE, smoothing: float = SMOOTHING, cost: float = COST, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, float] | None:
    """Learn from at most ``sample`` labelled documents; None if a class is missing.

    The sample is those of the least hashes of doc_id; labels other than 0 and
    1, null ids and null texts don't count, and an id with several labels has
    the least of them.  The model is fitted in one task over the sample, whose
    size doesn't depend on the corpus; only its weights reach the driver.
    """
    chosen = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    # at most ``sample`` ids and labels
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in textops.blocks(texts):
                found, offsets = ngrams(texts[a:b], bits)
                sets = [found[s:e].tobytes() for s, e in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(sets, pa.binary())], names=["doc_id", "y", "x"])

    def learn(batches):
        held = [(i, y, x) for b in batches for i, y, x in zip(*(c.to_pylist() for c in b.columns))]
        held.sort()  # the order of arrival must not matter
        xs, y = [np.frombuffer(x, np.int32) for _, _, x in held], np.array([2 * v - 1 for _, v, _ in held], np.float64)
        if len(set(y.tolist())) == 2:
            ratios = log_count_ratios(xs, y, 1 << bits, smoothing)
            weights, bias = dual_coordinate_descent(xs, ratios, y, cost, epochs, seed)
            # norms are of scaled rows, so the ratios go along
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([ratios.tobytes()]), pa.array([bias])], names=["weights", "ratios", "bias"])

    made = rows.mapInArrow(settled(features), "doc_id long, y int, x binary").repartition(1).mapInArrow(settled(learn), "weights binary, ratios binary, bias double").collect()
    if not made:
        return None
    return np.stack([np.frombuffer(made[0]["weights"], np.float64), np.frombuffer(made[0]["ratios"], np.float64)]), made[0]["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None, column: str, bits: int = FEATURE_BITS) -> DataFrame:
    """docs and a column of scores; null where the text is null or has no token, or there is no model."""
    if model is None:
        return docs.withColumn(column, F.lit(None).cast("double"))
    shared = docs.sparkSession.sparkContext.broadcast((model[0][0] * model[0][1], model[0][1] ** 2, model[1]))  # 4 MB, whatever the corpus

    @F.pandas_udf("double")
    def apply(text):
        product, square, bias = shared.value
        out = np.full(len(text), np.nan)
        texts = [t if t is not None else "" for t in text]
        for a, b in textops.blocks(texts):
            found, offsets = ngrams(texts[a:b], bits)
            has = np.diff(offsets) > 0
            if has.any():
                # each text is summed by itself, so that equal texts have equal scores
                dot, norm = (np.add.reduceat(x[found], offsets[:-1][has]) for x in (product, square))
                out[a:b][has] = dot / np.sqrt(np.maximum(norm, 1e-12)) + bias
        import pandas as pd

        return pd.Series(out)

    return docs.withColumn(column, F.nanvl(apply("text"), F.lit(None).cast("double")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """(doc_id, score, keep) for each row of docs.

    Features are the distinct uni- and bigrams of words (with their case) and
    of runs of punctuation, hashed to 2**18; each is scaled by its class
    log-count ratio.  Documents below ``threshold`` are rejected.

    A row without a score is kept: its text is null, empty or blank, or the
    labels lack a class.  Repeated rows each have a result; a null doc_id
    stays null.  Other columns are ignored.  No documents, no rows.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **parameters), "score", parameters.get("bits", FEATURE_BITS))
    return scored.select("doc_id", "score", F.coalesce(F.col("score") >= threshold, F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """The rows of docs that classify keeps, with docs' columns."""
    column = unique_name(docs, "quality_score")
    scored = score(docs, fit(docs, labels, **parameters), column, parameters.get("bits", FEATURE_BITS))
    return scored.where(F.col(column).isNull() | (F.col(column) >= threshold)).select(docs.columns)
