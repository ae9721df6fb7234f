"""A quality classifier from positive and unlabelled texts.

Trusted positives are texts labelled good; the rest of the training rows are unlabelled
web text, a mixture of good and bad. An additive model over binned text statistics
minimises the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss. The class prior is estimated first, as the least ratio of the
unlabelled to the positive share in regions of high score of a classifier of positives
against unlabelled texts: where no bad text falls, that ratio is the prior.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.common import with_columns

#: Rows that the model is fitted on, at most; the first by a hash of their doc_id.
POSITIVES, UNLABELLED = 6_000, 12_000
BINS, STEPS, RATE, DECAY = 12, 600, 0.05, 1e-4
STATISTICS = ("log_words", "word_length", "distinct", "top_word", "capitals", "symbols", "exclamations", "bars", "digits", "lines", "distinct_lines", "distinct_pairs", "stops", "non_ascii")


def statistics(text: str) -> tuple[float, ...]:
    """The numbers a score depends on; all are defined for an empty text."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    less = lambda chars: (len(raw) - len(raw.translate(None, chars))) / size
    counts = Counter(words)
    return (
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(map(bytes.isupper, words)) / n,
        less(b"#*$%&|<>"),
        raw.count(b"!") / n,
        raw.count(b"|") / n,
        less(b"0123456789"),
        len(lines) / n,
        len(set(lines)) / max(1, len(lines)),
        len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        sum(w[-1:] in (b".", b"?", b"!") for w in words) / n,
        (len(raw) - len(text)) / size,
    )


class Bins:
    """One-hot bins of each statistic, cut at quantiles of the unlabelled texts."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.starts = np.cumsum([0, *(len(e) + 1 for e in edges)])

    @classmethod
    def cut(cls, values: np.ndarray) -> list[np.ndarray]:
        return [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1])) for v in values.T]

    def places(self, values: np.ndarray) -> np.ndarray:
        return np.stack([s + np.searchsorted(e, v, side="right") for e, s, v in zip(self.edges, self.starts, values.T, strict=False)], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def descend(size: int, gradient) -> np.ndarray:
    """Weights after STEPS of Adam."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, STEPS + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def dense(places: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(places), size + 1), np.float32)
    np.put_along_axis(out, places, 1, axis=1)
    out[:, -1] = 1
    return out


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The estimated part of positives among ``u``, from every second row to fit and the others to measure."""
    fit_p, fit_u = p[::2], u[::2]

    def gradient(w):
        return -(fit_p.T @ sigmoid(-fit_p @ w)) / len(fit_p) + (fit_u.T @ sigmoid(fit_u @ w)) / len(fit_u)

    w = descend(p.shape[1], gradient)
    at_p, at_u = np.sort(p[1::2] @ w), np.sort(u[1::2] @ w)
    cuts = np.quantile(at_p, np.linspace(0, 0.5, 51))
    share = lambda at: 1 - np.searchsorted(at, cuts, side="left") / len(at)
    in_p, in_u = share(at_p), share(at_u)
    # A margin of one standard error keeps chance in small regions from pulling the estimate down.
    ratio = in_u / in_p + np.sqrt(in_u * (1 - in_u) / len(at_u)) / in_p + np.sqrt(in_p * (1 - in_p) / len(at_p)) * in_u / in_p**2
    return float(np.clip(ratio.min(), 0.05, 0.99))


def unbiased_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """The risk of positives as good, that of bad texts as bad, which should not be negative, and both gradients."""
    fp, fu = p @ w, u @ w
    good = prior * np.logaddexp(0, -fp).mean()
    bad = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
    return good, bad, -prior * (p.T @ sigmoid(-fp)) / len(p), (u.T @ sigmoid(fu)) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)


def fit(positives: np.ndarray, unlabelled: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, float]:
    """Bin edges, weights and the class prior, from the statistics of both samples."""
    if len(positives) < 4 or len(unlabelled) < 4:
        return [np.zeros(0)] * len(STATISTICS), np.zeros(len(STATISTICS) + 1), 0.5
    edges = Bins.cut(unlabelled)
    bins = Bins(edges)
    size = int(bins.starts[-1])
    p, u = dense(bins.places(positives), size), dense(bins.places(unlabelled), size)
    prior = class_prior(p, u)

    def gradient(w):
        _, risk, good, bad = unbiased_risk(w, p, u, prior)
        return good + bad if risk >= 0 else -bad

    return edges, descend(size + 1, gradient), prior


def held_out(doc_id):
    """Rows that nothing is learned from: crc32 of doc_id as text leaves 1 modulo 3. Without doc_id, true."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray, float]:
    """The model from at most POSITIVES trusted rows of ``docs`` and UNLABELLED others, none held out."""
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("__id"), F.lit(1).alias("__trusted")).distinct()
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("doc_id").distinct().join(trusted, F.col("doc_id") == F.col("__id"), "left")
    first = lambda d, n: d.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = first(rows.where("__trusted = 1"), POSITIVES).union(first(rows.where("__trusted IS NULL"), UNLABELLED)).select(F.col("doc_id").alias("__id"), "__trusted")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "trusted": batch["__trusted"].fillna(0).astype(bool), "x": [list(statistics(t)) for t in batch["text"]]})

    sample = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__trusted")
    got = sample.mapInPandas(run, "doc_id long, trusted boolean, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(STATISTICS))
    trusted_rows = got["trusted"].to_numpy(bool)
    return fit(x[trusted_rows], x[~trusted_rows])


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with held_out, score (0 to 1) and predicted (score >= 0.5).

    ``labels`` (doc_id, quality): rows with quality 1 are the trusted positives; no other
    label is used. A score depends on the text alone. A null text counts as an empty
    one; it is scored but never learned from. Equal texts have equal scores. Rows that share a doc_id are
    each scored by their own text, and each learned from if the id is picked. With fewer
    than 4 positives or unlabelled rows to learn from, every score is 0.5. Added columns
    replace others of their names; an empty table gives an empty table.
    """
    edges, weights, _ = learn(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        bins = Bins(edges)
        x = np.array([statistics(t or "") for t in texts], float).reshape(len(texts), len(STATISTICS))
        return pd.Series(sigmoid(weights[bins.places(x)].sum(axis=1) + weights[-1]))

    scored = with_columns(docs, held_out=held_out(F.col("doc_id")), score=score(F.col("text").cast("string")))
    return with_columns(scored, predicted=(F.col("score") >= 0.5).cast("int"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs, labels).select("doc_id", "held_out", "score", "predicted")
