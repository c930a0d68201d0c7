"""Quality: a classifier learnt from trusted positives and unlabelled text (nnPU)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrays import distinct_in, hash_runs, joined_codes, mix64, owners, parts, runs
from marquee.llm.labelled import held_out, labelled, sample
from marquee.session import durable

FEATURES = (
    "log_words", "word_length", "lower", "upper", "digit", "punctuation", "exclamation", "symbol",
    "distinct_words", "distinct_trigrams", "same_as_next", "words_a_line", "distinct_lines",
    "symbol_words", "upper_words", "long_words",
)
#: Rows of each kind, trusted and unlabelled, that the model is fitted on, at most.
TRAINING_ROWS = 20_000
STEPS, RATE, DECAY = 600, 0.05, 1e-3
#: Score from which a text is kept.
KEEP = 0.3

SPACE, LOWER, UPPER, DIGIT, PUNCTUATION, EXCLAMATION, SYMBOL, REST = range(8)


def _classes() -> np.ndarray:
    table = np.full(0x3001, REST, dtype=np.uint8)
    for code in range(0x3000):
        char = chr(code)
        if char.isspace():
            table[code] = SPACE
        elif char.islower():
            table[code] = LOWER
        elif char.isupper():
            table[code] = UPPER
        elif char.isdigit():
            table[code] = DIGIT
        elif char in ".,;:?'\"-()’“”«»¿¡":
            table[code] = PUNCTUATION
        elif char == "!":
            table[code] = EXCLAMATION
        elif not char.isalpha():
            table[code] = SYMBOL
    return table


def features(texts: list[str], classes: np.ndarray) -> np.ndarray:
    """One row of FEATURES per whole text; an empty text has zeros."""
    out = [_part(texts[a:b], classes) for a, b in parts(texts)]
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


def _part(texts: list[str], classes: np.ndarray) -> np.ndarray:
    n = len(texts)
    codes, bounds = joined_codes(texts)
    kind = classes[np.minimum(codes, 0x3000)]
    at = np.repeat(np.arange(n), np.diff(bounds))
    count = np.bincount(at * 8 + kind, minlength=8 * n).reshape(n, 8).astype(float)
    solid = np.maximum(1.0, count[:, 1:].sum(axis=1))
    begins, ends = runs(kind != SPACE)
    owner = owners(begins, bounds)
    words = np.bincount(owner, minlength=n).astype(float)
    many = np.maximum(1.0, words)
    hashes = hash_runs(codes, begins, ends)
    follows = np.zeros(len(hashes), dtype=bool)
    follows[:-1] = owner[1:] == owner[:-1]
    same = np.zeros(len(hashes), dtype=bool)
    same[:-1] = follows[:-1] & (hashes[1:] == hashes[:-1])
    third = np.zeros(len(hashes), dtype=bool)
    third[:-2] = owner[2:] == owner[:-2]
    heads = np.flatnonzero(third)
    step = np.uint64(3)
    grams = mix64(mix64(hashes[heads] * step + hashes[heads + 1]) * step + hashes[heads + 2]) if len(heads) else hashes[:0]
    upper = np.concatenate(([0], np.cumsum(kind == UPPER)))
    lower = np.concatenate(([0], np.cumsum(kind == LOWER)))
    shouted = (upper[ends] - upper[begins] >= 2) & (lower[ends] == lower[begins])
    signed = np.isin(kind[ends - 1], (SYMBOL, EXCLAMATION)) if len(ends) else np.zeros(0, dtype=bool)
    line_begins, line_ends = runs(codes != 10)
    line_owner = owners(line_begins, bounds)
    lines = np.maximum(1.0, np.bincount(line_owner, minlength=n))
    share = lambda flags: np.bincount(owner[flags], minlength=n) / many
    columns = [
        np.log1p(words),
        solid * (words > 0) / many,
        *(count[:, k] / solid for k in (LOWER, UPPER, DIGIT, PUNCTUATION, EXCLAMATION, SYMBOL)),
        distinct_in(owner, hashes, n) / many,
        distinct_in(owner[heads], grams, n) / np.maximum(1.0, words - 2),
        share(same),
        np.log1p(words / lines),
        distinct_in(line_owner, hash_runs(codes, line_begins, line_ends), n) / lines,
        share(signed),
        share(shouted),
        share(ends - begins > 24),
    ]
    return np.stack(columns, axis=1) * (words > 0)[:, None]


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1.0 / (1.0 + np.exp(-np.clip(_expand(x, self.mean, self.scale) @ self.weights, -30, 30)))


def _expand(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate((np.ones((len(z), 1)), z, z * z / 6), axis=1)


def _descend(gradient, width: int) -> np.ndarray:
    """Adam from zero; ``gradient`` maps weights to their gradient."""
    w, first, second = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, STEPS + 1):
        g = gradient(w)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = w - RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores: the best upper bound over all thresholds.

    Above any threshold, the unlabelled share is at least the prior times the positive share;
    thresholds that pass under half of the positives are too noisy to bound anything.
    """
    p, u = np.sort(positive), np.sort(unlabelled)
    at = p[: max(1, len(p) // 2)]
    above_p = 1.0 - np.searchsorted(p, at) / len(p)
    above_u = 1.0 - np.searchsorted(u, at) / len(u)
    noise = 1.0 / np.sqrt(len(p)) + 1.0 / np.sqrt(len(u))
    return float(np.clip(np.min((above_u + noise * 0.5) / above_p), 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Minimise the non-negative unbiased risk of logistic loss, with an estimated prior.

    Risk: prior * loss(positives as 1) + max(0, loss(unlabelled as 0) - prior * loss(positives as 0)).
    Where the second part falls below zero its gradient is reversed, as in the nnPU algorithm.
    """
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), None, 0.5)
    everything = np.concatenate((positive, unlabelled))
    mean, scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    p, u = _expand(positive, mean, scale), _expand(unlabelled, mean, scale)
    ridge = np.ones(p.shape[1])
    ridge[0] = 0

    def apart(w: np.ndarray) -> np.ndarray:
        return -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + DECAY * ridge * w

    w = _descend(apart, p.shape[1])
    prior = estimate_prior(p @ w, u @ w)

    def risk(w: np.ndarray) -> np.ndarray:
        fp, fu = p @ w, u @ w
        as_one = -p.T @ (1 - _sigmoid(fp)) / len(p)
        as_zero = u.T @ _sigmoid(fu) / len(u) - prior * (p.T @ _sigmoid(fp)) / len(p)
        rest = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        if rest < 0:
            return -as_zero + DECAY * ridge * w
        return prior * as_one + as_zero + DECAY * ridge * w

    return Model(mean, scale, _descend(risk, p.shape[1]), prior)


def score_quality(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """One row per document: key, held_out, score, predicted (score >= KEEP).

    Trusted positives are training rows labelled 1; rows labelled 0 teach nothing, and the
    unlabelled text is the documents without a label.  Both are sampled to at most
    TRAINING_ROWS rows by a hash of the key.  Training rows are those whose crc32 of the key as
    text is no multiple of 5 (a null key counts as an empty text).

    A null text counts as empty; its features are zeros and it is scored like others.  Without
    positives or without unlabelled documents every score is 0.5.  Labels of one key count
    once, the largest.  Repeated documents score alike.  Other columns are ignored.
    """
    classes = _classes()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = features([t or "" for t in batch["_text"]], classes)
            yield pd.DataFrame({"_id": batch["_id"], "_x": list(values)})

    kind = docs.schema[key].dataType.simpleString()
    measured = durable(
        docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInPandas(
            measure, f"_id {kind}, _x array<double>"
        )
    )
    known = durable(labelled(labels, key, label))
    teaching = (
        measured.where(~held_out("_id"))
        .join(known.select("_id", "_label"), "_id", "left")
        .where("_label IS NULL OR _label = 1")
        .select("_id", "_x", F.coalesce("_label", F.lit(0)).alias("_trusted"))
    )
    rows = sample(teaching, "_trusted", TRAINING_ROWS).toPandas()  # at most 2 * TRAINING_ROWS rows
    x = np.array(rows["_x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    trusted = rows["_trusted"].to_numpy(dtype=int) == 1
    model = fit(x[trusted], x[~trusted])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["_x"].tolist(), dtype=float).reshape(len(batch), len(FEATURES))
            yield pd.DataFrame({key: batch["_id"], "score": model.score(x)})

    scored = measured.mapInPandas(score, f"`{key}` {kind}, score double")
    return scored.select(
        key, held_out(key).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; all columns.

    Rows with one key are kept or rejected by the best of their scores.
    """
    scored = score_quality(docs, labels, key, text)
    best = scored.groupBy(F.col(key).alias("_id")).agg(F.max("predicted").alias("_best"))
    rejected = durable(best.where("_best = 0").select("_id"))
    return docs.join(rejected, docs[key].eqNullSafe(rejected["_id"]), "left_anti")
