"""Language ID by rank-order profiles.

A profile is a list of the most frequent n-grams of characters (one to three), most
frequent first. Each language has one, from its training texts; a document gets one of
its own, and goes to the language at the least out-of-place distance: the sum, over the
document's n-grams, of how far apart the two ranks are, or PROFILE where the language's
profile lacks the n-gram.

Characters are letters, lower-cased; each run of others is one space. Equal counts rank
by length, then by code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import with_columns
from fieldweave.llm.quality_pu import held_out

PROFILE, LONGEST = 300, 3
#: Texts of a language that its profile is made of, at most; the first by a hash of their doc_id.
TEXTS = 1_000
NOT_LETTERS = re.compile(r"[\W\d_]+")
UNKNOWN = "und"


def letters(text: str) -> np.ndarray:
    """Code points of the text's letters, lower-cased, with one space round each word; empty without a letter."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):
        return np.zeros(0, np.int64)
    return np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.int64)


def gram_counts(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams and their counts, by length, then code points. A text's own few characters keep the tables small."""
    own, at = np.unique(points, return_inverse=True)
    grams, counts = [], []
    code, packed_size = np.zeros(len(points), np.int64), 1
    for n in range(1, LONGEST + 1):
        code = (code[: len(points) - n + 1] * len(own) + at[n - 1 :]) if n > 1 else at.astype(np.int64)
        packed_size *= len(own)
        if not len(code):
            break
        if packed_size <= 8 * len(code) + 4096:
            table = np.bincount(code, minlength=packed_size)
            which = np.flatnonzero(table)
            number = table[which]
        else:
            which, number = np.unique(code, return_counts=True)
        packed, rest = np.zeros(len(which), np.int64), which
        for i in range(n):
            packed |= own[rest % len(own)] << (21 * i)
            rest = rest // len(own)
        grams.append(packed)
        counts.append(number)
    return np.concatenate(grams), np.concatenate(counts)


def profile(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return grams[np.argsort(-counts, kind="stable")[:PROFILE]]


def learn(docs: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """Languages in order of name and their profiles, from at most TEXTS texts of each that are not held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"))
    # First the best of each of 64 parts of a language, so one with most rows is not ordered in one task.
    for by in (["lang", F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(64))], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
        rows = rows.withColumn("place", place).where(F.col("place") <= TEXTS)
    picked = rows.select(F.col("doc_id").alias("__id"), F.col("lang").alias("__lang")).distinct()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("__lang")["text"]:
                found = [gram_counts(p) for p in map(letters, texts) if len(p)]
                if found:
                    grams, counts = (np.concatenate(x) for x in zip(*found, strict=True))
                    own, at = np.unique(grams, return_inverse=True)
                    yield pd.DataFrame({"lang": lang, "gram": own, "n": np.bincount(at, counts).astype(np.int64)})

    texts = docs.select("doc_id", "lang", "text").join(picked, (F.col("doc_id") == F.col("__id")) & (F.col("lang").cast("string") == F.col("__lang"))).select("__lang", "text")
    counts = texts.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Packed n-grams of a length sort by length, as a longer one has a higher code point set.
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", best).where(F.col("place") <= PROFILE).orderBy("lang", "place").toPandas()
    names = sorted(top["lang"].unique())
    return names, [top.loc[top["lang"] == name, "gram"].to_numpy(np.int64) for name in names]


class Profiles:
    def __init__(self, names: list[str], lists: list[np.ndarray]):
        self.names = names
        self.sorted = [(np.sort(x), np.argsort(x)) for x in lists]

    def predict(self, text: str | None) -> tuple[str, float]:
        points = letters(text) if text else np.zeros(0, np.int64)
        if not len(points) or not self.names:
            return UNKNOWN, 0.0
        own = profile(*gram_counts(points))
        rank = np.arange(len(own))
        far = []
        for grams, ranks in self.sorted:
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            far.append(int(np.where(grams[at] == own, np.abs(ranks[at] - rank), PROFILE).sum()))
        least = int(np.argmin(far))
        return self.names[least], 1 - far[least] / (PROFILE * len(own))


def identify(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) with held_out, lang_pred and score (0 to 1).

    lang_pred: the nearest learned language, the first by name on equal distance; "und"
    if the text is null or has no letter, or nothing was learned. score: 1 minus the
    distance as a part of the largest possible one, 0 for "und". A prediction depends on
    the text alone. Rows without lang are predicted, not learned from. Added columns
    replace others of their names; an empty table gives an empty table.
    """
    names, lists = learn(docs)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        profiles = Profiles(names, lists)
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    guessed = with_columns(docs, held_out=held_out(F.col("doc_id")), __p=predict(F.col("text").cast("string")))
    return with_columns(guessed, lang_pred=F.col("__p.lang_pred"), score=F.col("__p.score")).drop("__p")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
