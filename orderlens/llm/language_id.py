"""Language identification by hierarchical discrimination.

A linear support vector machine over hashed letter bigrams and trigrams of
the whole text picks the language family; within the family, one-versus-one
machines vote between its languages.  Training reads a bounded sample: at
most ``PER_LANGUAGE`` labelled documents of each language, those with the
smallest hash of doc_id (of rows that share a doc_id, the smallest text).  The features of the sample are computed
by the executors, and Spark ML fits the machines on them.

Defined results: ``und`` with score 0 for a text that is null or has no
letter, and for every text when nothing can be learned; a null doc_id is
not held out and not learned from; ties between languages go to the first
by code point; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F

from .common import packed, store, text_of

#: Families of languages; a language that is not listed is its own family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"],
}
BITS = 12                           # 2^BITS hashed features
PER_LANGUAGE = 500                  # bound of the training sample, documents of a language
SPARE = 4                           # times the bound of documents that are ranked for the sample
CHUNK = 1 << 20                     # letters hashed at once
TASKS = 4                           # of a training step over the sample
STEEPNESS = 4.0                     # of the curve from margin to score


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def profile(text: str, bits: int = BITS) -> np.ndarray | None:
    """Unit vector of the square roots of hashed bigram and trigram counts; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return None
    letters = np.concatenate(([32], np.where(is_letter, points, 32), [32])).astype(np.uint32)
    counts = np.zeros(1 << bits)
    for at in range(0, len(letters) - 1, CHUNK):
        part = letters[at:at + CHUNK + 2]
        pairs = part[:-1] * np.uint32(0x9E3779B1) + part[1:] * np.uint32(0x85EBCA77)
        triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + part[2:] * np.uint32(0x27D4EB2F)
        for grams in (pairs[:CHUNK], triples):
            counts += np.bincount((grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits), minlength=1 << bits)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def _sample(docs: DataFrame, per_language: int) -> DataFrame:
    """(lang, features) of the training sample."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("hash"), F.col("lang").cast("string").alias("lang"), "text")
    # Of each language, hashes below a share of all that leaves SPARE times the bound: the ranking sees that many rows, however large the language
    ids = known.groupBy("lang").agg(F.approx_count_distinct("hash").alias("ids"))       # one row a language
    least, span = -float(1 << 63), float(1 << 64)
    few = known.join(F.broadcast(ids), "lang").where(F.col("hash") < least + span * F.least(F.lit(1.0), SPARE * per_language / F.col("ids")))
    order = Window.partitionBy("lang").orderBy("hash", "id")
    rows = (few.groupBy("lang", "id", "hash").agg(F.min("text").alias("text"))
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_language).select("lang", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(a, v.astype(np.float32)) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                     if (v := profile(b)) is not None]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([a for a, _ in found], pa.string()),
                                              "features": pa.array([v for _, v in found], pa.list_(pa.float32()))})

    return rows.mapInArrow(run, "lang string, features array<float>")


def _machine(rows: DataFrame, positive: list[str], negative: list[str]) -> tuple[np.ndarray, float]:
    """Weights and intercept that separate the languages ``positive`` from ``negative``."""
    some = rows.where(F.col("lang").isin(positive + negative)).select(
        F.col("lang").isin(positive).cast("double").alias("label"), array_to_vector("features").alias("features"))
    fitted = LinearSVC(maxIter=25, regParam=1e-4, standardization=False).fit(some)
    return np.array(fitted.coefficients), float(fitted.intercept)


class Model:
    """The fitted machines: one for each family against the rest, one for each two languages of a family."""

    def __init__(self, families: dict[str, list[str]], weights: np.ndarray, bias: np.ndarray):
        self.names, self.families, self.weights, self.bias = sorted(families), families, weights, bias

    def predict(self, text: str | None) -> tuple[str, float]:
        vector = profile(text) if text and self.names else None
        if vector is None:
            return "und", 0.0
        chance = 1 / (1 + np.exp(-STEEPNESS * (self.weights @ vector + self.bias)))
        at, score = 0, 1.0
        family = self.names[0]
        if len(self.names) > 1:
            best = int(np.argmax(chance[:len(self.names)]))
            family, score, at = self.names[best], float(chance[best]), len(self.names)
        for name in self.names:
            langs = self.families[name]
            pairs = list(combinations(range(len(langs)), 2))
            if name == family:
                wins, sure = np.zeros(len(langs)), np.zeros(len(langs))
                for (a, b), p in zip(pairs, chance[at:at + len(pairs)]):
                    wins[a if p >= 0.5 else b] += 1
                    sure[a] += p
                    sure[b] += 1 - p
                winner = max(range(len(langs)), key=lambda i: (wins[i], sure[i], -i))
                return langs[winner], score * (float(sure[winner]) / (len(langs) - 1) if pairs else 1.0)
            at += len(pairs)
        raise AssertionError(family)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from (doc_id, text, lang)."""
    rows = store(_sample(docs, per_language), "language-sample").coalesce(TASKS)
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())       # the languages, not the documents
    family = {lang: name for name, members in FAMILIES.items() for lang in members}
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family.get(lang, lang), []).append(lang)
    names = sorted(families)
    machines = [_machine(rows, families[n], [x for x in langs if x not in families[n]]) for n in names if len(names) > 2]
    if len(names) == 2:                 # the second is the mirror image of the first
        weights, bias = _machine(rows, families[names[0]], families[names[1]])
        machines = [(weights, bias), (-weights, -bias)]
    machines += [_machine(rows, [a], [b]) for n in names for a, b in combinations(families[n], 2)]
    return Model(families, np.array([w for w, _ in machines]).reshape(-1, 1 << BITS), np.array([b for _, b in machines]))


def with_language(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``rows`` without the column ``text``, plus lang_pred and score."""
    rest = rows.drop(text)
    schema = rest.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    given = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [given.value.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index(text))]
            names = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(n)) for n in names),
                 pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)


def _learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learned from the documents not held out."""
    model = fit(_learnable(docs), per_language)
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return with_language(rows, model)


def recognised(docs: DataFrame, least: float = 0.0, per_language: int = PER_LANGUAGE) -> DataFrame:
    """The documents with a language, scored ``least`` or more, with all their columns."""
    model = fit(_learnable(docs), per_language)
    rows = docs.select(packed(docs).alias("document"), F.col("text").cast("string").alias("text"))
    return with_language(rows, model).where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("document.*")
