"""Shingle overlap between applications, and vector change measures of matched pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.binding import let
from pairwright.operators import packedjoin
from pairwright.operators.setjoin import PPM, similar_sets

# Shingle width, similarity thresholds for review flags.
SHINGLE_TOKENS = 5
AGGREGATE_THRESHOLD = 0.55
LANGUAGE_THRESHOLD = 0.70
LAYOUT_THRESHOLD = 0.90
STRUCTURE_THRESHOLD = 0.92
ALL_LANGUAGES = "all"


def shingles(text: Column, width: int = SHINGLE_TOKENS) -> Column:
    """A 96-bit key for every run of ``width`` tokens of the whole text, repeats included.

    Tokens are hashed one after the other, so no shingle text is built; two independent hashes keep
    accidental meetings out of reach at any corpus size.
    """
    return _runs(text, width, lambda run: F.struct(F.xxhash64(*run).alias("a"), F.hash(*run).alias("b")))


def shingle_hashes(text: Column, width: int = SHINGLE_TOKENS) -> Column:
    """The first 64 bits of the same keys, for sets that are only compared two at a time."""
    return _runs(text, width, lambda run: F.xxhash64(*run))


def _runs(text: Column, width: int, key: Callable[[list[Column]], Column]) -> Column:
    def runs(tokens: Column) -> Column:
        count = F.size(tokens) - width + 1
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: key([F.get(tokens, i + offset) for offset in range(width)]))

    return let(F.filter(F.split(text, r"[ \t\r\n]+"), lambda token: token != ""), runs)


def shingle_similarity(
    documents: DataFrame,
    application: str,
    language: str,
    text: str,
    aggregate_threshold: float = AGGREGATE_THRESHOLD,
    language_threshold: float = LANGUAGE_THRESHOLD,
) -> DataFrame:
    """Application pairs whose shingle sets reach a Jaccard threshold, over all languages and per language.

    ``(language, left, right, n_left, n_right, n_both, jaccard_ppm)``; applications with equal sets are paired with the smallest of them
    alone. Texts are the whole texts of an application; null ones have no shingles.
    """
    limits = [round(threshold * PPM) for threshold in (aggregate_threshold, language_threshold)]
    rows = documents.select(F.col(language).alias("language"), F.col(application).alias("application"), F.col(text).alias("text"))
    if rows.groupBy("application").count().where("application is not null and count > 1").isEmpty():
        named = rows.select(F.col("application").alias("owner"), F.col("language").alias("label"), "text")
        return packedjoin.similar_documents(named, "text", shingle_hashes, *limits, ALL_LANGUAGES).withColumnRenamed("label", "language")
    # an application of several rows may have a set of any size, so its shingles are rows
    held = rows.select("language", "application", F.explode(shingles(F.col("text"))).alias("_s"))
    per_language = held.select("language", "application", F.col("_s.a").alias("_a"), F.col("_s.b").cast("long").alias("_b")).distinct()
    overall = per_language.select(F.lit(ALL_LANGUAGES).alias("language"), "application", "_a", "_b").distinct()
    within = per_language.where(~F.col("language").eqNullSafe(ALL_LANGUAGES))
    limit = F.when(F.col("language").eqNullSafe(ALL_LANGUAGES), limits[0]).otherwise(limits[1])
    return similar_sets(within.unionByName(overall), "language", "application", ["_a", "_b"], limit)


def matched_vectors(vectors: DataFrame, pair: Column, is_baseline: Column, vector: str) -> DataFrame:
    """``(pair, before, after)``: the two members of each pair by an equi-join on the pair id."""
    values = F.transform(vector, lambda v: v.cast("double"))
    before = vectors.where(is_baseline).select(pair.alias("pair"), values.alias("before"))
    after = vectors.where(~is_baseline).select(pair.alias("pair"), values.alias("after"))
    return before.join(after, "pair")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def absolute_change(before: Column, after: Column) -> Column:
    """Sum of absolute element changes."""
    return total(F.zip_with(before, after, lambda a, b: F.abs(a - b)))


def cosine(before: Column, after: Column) -> Column:
    dot = total(F.zip_with(before, after, lambda a, b: a * b))
    norms = F.sqrt(total(F.transform(before, lambda a: a * a)) * total(F.transform(after, lambda b: b * b)))
    return F.when(norms > 0, dot / norms)


# Stabilising constants of the similarity index for values in a unit range.
STRUCTURE_C1 = 0.01**2
STRUCTURE_C2 = 0.03**2


def structure_index(before: Column, after: Column) -> Column:
    """Structural similarity in closed form, from population means, variances and covariance."""
    n = F.size(before)
    mean_b, mean_a = total(before) / n, total(after) / n
    var_b = total(F.transform(before, lambda v: v * v)) / n - mean_b * mean_b
    var_a = total(F.transform(after, lambda v: v * v)) / n - mean_a * mean_a
    cov = total(F.zip_with(before, after, lambda x, y: x * y)) / n - mean_b * mean_a
    top = (2 * mean_b * mean_a + STRUCTURE_C1) * (2 * cov + STRUCTURE_C2)
    bottom = (mean_b * mean_b + mean_a * mean_a + STRUCTURE_C1) * (var_b + var_a + STRUCTURE_C2)
    return top / bottom


def conjunctive_flags(
    pairs: DataFrame,
    keys: Sequence[str],
    layout: Column,
    structure: Column,
    layout_threshold: float = LAYOUT_THRESHOLD,
    structure_threshold: float = STRUCTURE_THRESHOLD,
) -> DataFrame:
    """Flag pairs that reach both thresholds."""
    measured = pairs.select(*keys, layout.alias("layout"), structure.alias("structure"))
    both = (F.col("layout") >= layout_threshold) & (F.col("structure") >= structure_threshold)
    return measured.withColumn("flagged", F.coalesce(both, F.lit(False)))
