"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training uses at most ``SAMPLE_PER_CLASS`` labelled documents of either label, in the order of a hash
of their ids; the driver gets the chosen features and their places in those documents only. Features
are the distinct n-grams of a text (A-Z in lower case, runs of white space as one space). A feature's
log-count ratio r is that of its smoothed document counts in both labels; at most ``MAX_FEATURES``
are used, those whose ratios are most clearly non-zero. Logistic regression with L2 penalty is
fitted on the features scaled by r, and its intercept is moved from the sample's balance to the
share of toxic labels in all training labels.

Defined cases: a null or empty text has no features and gets the intercept's score; repeated rows
are scored one by one; without training labels of both kinds every score is the share of toxic
labels (0 without labels); null labels are ignored, repeated ones count once per document, the highest; of the texts
that share a training id the least is learnt from;
extra columns are not returned by ``score_toxicity`` and untouched by ``toxicity_filter``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, spread, stage

ORDERS = (3, 4, 5)
SAMPLE_PER_CLASS = 1200
MIN_DOCS = 5
MIN_Z = 3.0
MAX_FEATURES = 50_000
PENALTY = 0.5
THRESHOLD = 0.3
STEPS = 300

_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[0x41:0x5B] += 32
_FOLDED[[9, 10, 11, 12, 13]] = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class ToxicityModel:
    features: np.ndarray  # sorted 64-bit hashes of n-grams
    weights: np.ndarray
    intercept: float


def gram_hashes(text: str) -> np.ndarray:
    """64-bit hashes of all n-grams of a text, in bytes, with repeats."""
    raw = _FOLDED[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    if len(raw) > 1:
        raw = raw[np.concatenate(([True], (raw[1:] != 32) | (raw[:-1] != 32)))]
    wide = raw.astype(np.uint64) + np.uint64(1)
    out = []
    value = wide.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(wide) < n:
            break
        value = value[: len(wide) - n + 1] * np.uint64(257) + wide[n - 1 :]
        if n in ORDERS:
            mixed = value * _MULTIPLIER
            out.append((mixed ^ (mixed >> np.uint64(29))) * _MULTIPLIER)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sample(docs: DataFrame, known: DataFrame, per_class: int, text_col: str) -> DataFrame:
    """(toxic, text) of the training sample, as a table: one text per id, the least where an id repeats."""
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    few = F.broadcast(chosen[0].union(chosen[1]))  # 2 * per_class rows at most
    picked = docs.select("doc_id", F.col(text_col).alias("text")).join(few, "doc_id")
    single = picked.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return stage(single.select("toxic", "text").repartition(16), "toxic")


def _ratio(pos, neg, n_pos: int, n_neg: int, log):
    """(log-count ratio, its size in standard errors) from a feature's document counts."""
    ratio = log((pos + 1) / (n_pos + 2)) - log((neg + 1) / (n_neg + 2))
    return ratio, ratio / (1 / (pos + 1) + 1 / (neg + 1)) ** 0.5


def _features(sample: DataFrame, n_pos: int, n_neg: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, log-count ratios) of at most MAX_FEATURES n-grams with the surest ratios."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            grams = [np.unique(gram_hashes(t or "")) for t in batch["text"]]
            ids, at = np.unique(np.concatenate(grams), return_inverse=True)
            toxic = np.repeat(batch["toxic"].to_numpy(), [len(g) for g in grams])
            pos = np.bincount(at, weights=toxic, minlength=len(ids)).astype(np.int64)
            yield pd.DataFrame({"g": ids.view(np.int64), "pos": pos, "neg": np.bincount(at, minlength=len(ids)) - pos})

    counted = sample.mapInPandas(run, "g long, pos long, neg long").groupBy("g").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio, sure = _ratio(F.col("pos"), F.col("neg"), n_pos, n_neg, F.log)
    chosen = (
        counted.where(F.col("pos") + F.col("neg") >= MIN_DOCS)
        .select("g", ratio.alias("ratio"), F.abs(sure).alias("sure"))
        .where(F.col("sure") >= MIN_Z)
        .orderBy(F.desc("sure"), "g")
        .limit(MAX_FEATURES)
        .toPandas()
    )
    features = chosen["g"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(features)
    return features[order], chosen["ratio"].to_numpy(dtype=float)[order]


def _rows(sample: DataFrame, features: np.ndarray) -> pd.DataFrame:
    """(toxic, places): the places of each sampled text's n-grams among the features."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places = [np.flatnonzero(np.isin(features, gram_hashes(t or ""))).astype("<u4").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "places": places})

    return sample.mapInPandas(run, "toxic int, places binary").toPandas()


def fit(places: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the penalised logistic regression on features scaled by ``ratio``."""
    cols = np.concatenate(places).astype(np.int64)
    rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
    y = toxic.astype(float)
    values, m = ratio[cols], len(ratio)
    u, b = np.zeros(m), 0.0
    momentum_u, momentum_b = np.zeros(m), 0.0
    largest = 0.25 * 4 * (np.bincount(rows, weights=values**2, minlength=len(y)).mean() + 1) + PENALTY / len(y)
    for step in range(STEPS):
        look = step / (step + 3)
        tu, tb = u + look * momentum_u, b + look * momentum_b
        margin = np.bincount(rows, weights=values * tu[cols], minlength=len(y)) + tb
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) / len(y)
        grad = np.bincount(cols, weights=values * error[rows], minlength=m) + PENALTY * tu / len(y)
        new_u, new_b = tu - grad / largest, tb - error.sum() / largest
        momentum_u, momentum_b = new_u - u, new_b - b
        u, b = new_u, new_b
    moved = np.log(share / (1 - share)) - np.log(y.sum() / (len(y) - y.sum()))
    return u * ratio, float(b + moved)


def train_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, per_class: int = SAMPLE_PER_CLASS, text_col: str = "text") -> ToxicityModel:
    """Fit on labelled rows where ``train`` (a condition on doc_id; default: all) holds."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    if train is not None:
        known = known.where(train)
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    share = counts["toxic"] / counts["n"] if counts["n"] else 0.0
    edge = float(np.clip(share, 1e-9, 1 - 1e-9))
    constant = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(edge / (1 - edge))))
    if not 0 < share < 1:
        return constant
    sample = _sample(docs, known, per_class, text_col)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return constant
    features, ratio = _features(sample, sizes[1], sizes[0])
    if not len(features):
        return constant
    rows = _rows(sample, features)
    weights, intercept = fit([np.frombuffer(p, "<u4") for p in rows["places"]], rows["toxic"].to_numpy(), ratio, share)
    return ToxicityModel(features, weights, intercept)


def _filter_bits(features: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(features >> np.uint64(44)).astype(np.int64)] = True
    return bits


def text_score(text: str, model: ToxicityModel, bits: np.ndarray) -> float:
    grams = gram_hashes(text)
    grams = np.unique(grams[bits[(grams >> np.uint64(44)).astype(np.int64)]])
    total = model.intercept
    if len(grams) and len(model.features):
        at = np.minimum(np.searchsorted(model.features, grams), len(model.features) - 1)
        total += model.weights[at[model.features[at] == grams]].sum()
    return float(1 / (1 + np.exp(-np.clip(total, -700, 700))))


def toxicity_score(model: ToxicityModel):
    """Pandas UDF of a text column: probability of the toxic label."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bits = _filter_bits(model.features)
        for texts in batches:
            yield pd.Series([text_score(t or "", model, bits) for t in texts], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted)."""
    texts = spread(docs.select("doc_id", F.col(text_col).alias("text")))
    scored = texts.select("doc_id", toxicity_score(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity_filter(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    return spread(docs).where(toxicity_score(model)(F.col(text_col)) < THRESHOLD)


def training_fold(doc_id: Column) -> Column:
    return fold(doc_id, 4) != 2
