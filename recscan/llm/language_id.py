"""Language identification in two steps: the family first, then the language within it.

Both steps vote among one-versus-one linear support vector machines, trained by Spark's
LinearSVC on hashed character n-grams: between families, and between the languages of a family.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LinearSVC
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recscan.llm.shared import small_batches

#: About so many rows of each language, taken by hashed id, are learned from; MAX_TRAIN in all.
PER_LANGUAGE, MAX_TRAIN = 1_500, 30_000
#: Hashed features for n-grams of 1, 2 and 3 characters.
BITS, GRAMS = 13, 3
UNDETERMINED = "und"
#: So many machines are fitted at a time.
FITS = 4

# Families of language codes. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fo fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indo-aryan": "hi ur bn pa gu mr ne si",
    "turkic": "tr az kk ky uz tk tt",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0].split("_")[0], lang)


def family_col(lang: str) -> Column:
    """As :func:`family`, for a column."""
    known = F.create_map(*[F.lit(x) for pair in _FAMILY_OF.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.split(F.lower(lang), "[-_]")[0]), F.col(lang))


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---- features -----------------------------------------------------------------------------

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def profile(text: str | None) -> np.ndarray | None:
    """Unit vector of square roots of n-gram counts; None without a letter. Words are set apart."""
    letters = _NOT_LETTERS.sub(" ", (text or "").lower())
    if not any(map(str.isalpha, letters)):
        return None
    code = np.frombuffer(f" {letters.strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.zeros(1 << BITS, np.int64)
    mixed = np.zeros(len(code), np.uint32)
    for n in range(GRAMS):
        if n < len(code):
            mixed = mixed[: len(code) - n] * np.uint32(0x01000193) + code[n:] * np.uint32(0x9E3779B1) + np.uint32(n)
            counts += np.bincount((mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS), minlength=1 << BITS)
    x = np.sqrt(counts)
    return x / np.linalg.norm(x)


# ---- learning -----------------------------------------------------------------------------


class Duel(NamedTuple):
    """A support vector machine between two names; a positive margin is for the first."""

    first: str
    second: str
    weights: np.ndarray
    bias: float


class Model(NamedTuple):
    families: dict[str, list[str]]
    between: list[Duel]
    within: dict[str, list[Duel]]


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, max_train: int = MAX_TRAIN) -> DataFrame:
    """text and lang of a bounded sample of rows with a language that are not held out.

    Each language gives the rows whose hashed id falls below its share, about ``per_language``
    of them, so that frequent languages don't crowd out others; ``max_train`` bounds the whole.
    Ids are drawn first, so that no text moves but those drawn.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # one number for each language
    counts = known.groupBy("lang").count().orderBy("lang").collect()
    if not counts:
        return known.select("text", "lang").limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], per_language / r["count"])])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    ids = known.filter(chance < share[F.col("lang")]).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train).distinct()
    # max_train bounds what is broadcast: a number a row
    return known.join(F.broadcast(ids), "doc_id", "left_semi").select("text", "lang")


def _duel(rows: DataFrame, first: str, second: str) -> Duel:
    two = rows.filter(F.col("name").isin(first, second)).select("features", (F.col("name") == first).cast("double").alias("label"))
    fitted = LinearSVC(maxIter=25, regParam=1e-4, standardization=False).fit(two)
    return Duel(first, second, fitted.coefficients.toArray().astype(np.float32), float(fitted.intercept))


def train(docs: DataFrame) -> Model:
    """Learns from text and lang alone; ids only choose which rows."""
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(x, lang) for t, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True) if (x := profile(t)) is not None]
            at = [np.flatnonzero(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang for _, lang in found], pa.string()), pa.array(at, pa.list_(pa.int32())), pa.array([x[k] for (x, _), k in zip(found, at, strict=True)], pa.list_(pa.float64()))],
                ["lang", "at", "value"],
            )

    vector = F.udf(lambda at, value: SparseVector(1 << BITS, at, value), VectorUDT())
    rows = training_rows(docs).mapInArrow(scan, "lang string, at array<int>, value array<double>")
    rows = rows.select("lang", family_col("lang").alias("family"), vector("at", "value").alias("features")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # one row per language
        families: dict[str, list[str]] = {}
        for lang in sorted(r["lang"] for r in rows.select("lang").distinct().collect()):
            families.setdefault(family(lang), []).append(lang)
        # the machines do not depend on one another: some are fitted at a time
        pairs = [("family", "", a, b) for a, b in combinations(sorted(families), 2)]
        pairs += [("lang", f, a, b) for f, langs in families.items() for a, b in combinations(langs, 2)]
        with ThreadPool(FITS) as pool:
            duels = pool.map(inheritable_thread_target(docs.sparkSession)(lambda p: _duel(rows.withColumnRenamed(p[0], "name"), *p[2:])), pairs)
        between = [d for p, d in zip(pairs, duels, strict=True) if p[0] == "family"]
        within = {f: [d for p, d in zip(pairs, duels, strict=True) if p[:2] == ("lang", f)] for f in families}
    finally:
        rows.unpersist()
    return Model(families, between, within)


# ---- prediction ---------------------------------------------------------------------------


def _vote(names: list[str], duels: list[Duel], x: np.ndarray) -> tuple[str, float]:
    """The name with the most votes, then the largest margins; its mean chance in its duels."""
    if len(names) == 1:
        return names[0], 1.0
    votes, chance = dict.fromkeys(names, 0.0), {n: [] for n in names}
    for d in duels:
        margin = float(d.weights @ x) + d.bias
        p = 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))
        for name, q in ((d.first, p), (d.second, 1 - p)):
            votes[name] += (q > 0.5) + q / (2 * len(names))
            chance[name].append(q)
    best = max(names, key=lambda n: (votes[n], n))
    return best, float(np.mean(chance[best]))


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """(language, score) of a whole text; und and 0 without a letter, or if nothing was learned."""
    x = profile(text)
    if x is None or not model.families:
        return UNDETERMINED, 0.0
    kin, sure = _vote(sorted(model.families), model.between, x)
    lang, surer = _vote(model.families[kin], model.within[kin], x)
    return lang, sure * surer


def identify(docs: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    A text that is null or has no letter is und with score 0. Only the text is an input; ids
    (null too) and repeated rows stay as they are. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [predict(model, t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, "id " + kind + ", lang_pred string, score double").withColumnRenamed("id", id_col)
