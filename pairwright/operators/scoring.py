"""Ranking, calibration and bootstrap metrics over score histograms.

Scores are integers from 0 to SCALE. Every metric starts from counts per distinct score, so tied scores
form one threshold, the shuffle carries counts, and a window over a histogram has a bounded length
whatever the number of rows.
A metric over a single class is undefined and comes out null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.audit import percentile_report
from pairwright.operators.keyed import blocked_window
from pairwright.operators.splits import fold_roles
from pairwright.session import cut_lineage

SCALE = 1_000_000

SCORE_BLOCK = 16_384
RESAMPLE_CHUNK = 250

# Calibration bins, benign false-positive budget, bootstrap settings, parity bound.
CALIBRATION_BINS = 10
BENIGN_FPR = 0.05
RESAMPLES = 10_000
BOOTSTRAP_SEED = 20_260_715
PARITY_LIMIT = 1e-6


def histogram(rows: DataFrame, keys: Sequence[str], score: str, positive: Column) -> DataFrame:
    """``(keys..., score, pos, n)``."""
    return rows.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count(F.lit(1)).alias("n")
    )


def merged(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return counts.groupBy(*keys, "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def cumulative(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``tp`` and ``taken``: positives and rows at or above each score, in blocks of neighbouring scores."""
    falling = counts.withColumn("_falling", -F.col("score"))
    block = F.floor(F.col("_falling") / SCORE_BLOCK)
    running = {"tp": F.col("pos"), "taken": F.col("n")}
    return blocked_window(falling, keys, ["_falling"], block, running=running).drop("_falling")


def ranking_metrics(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., n_rows, n_positive, average_precision, auroc)``.

    Average precision sums precision times recall gain over distinct scores; AUROC gives ties half.
    """
    steps = cumulative(counts, keys)
    negatives = F.col("n") - F.col("pos")
    facts = steps.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        F.sum("pos").alias("n_positive"),
        F.sum(F.col("pos") * F.col("tp") / F.col("taken")).alias("_gain"),
        F.sum((negatives * (2 * (F.col("tp") - F.col("pos")) + F.col("pos"))).cast("decimal(38,0)")).alias("_order"),
    )
    positives = F.col("n_positive")
    others = F.col("n_rows") - positives
    defined = (positives > 0) & (others > 0)
    return facts.select(
        *keys,
        "n_rows",
        "n_positive",
        F.when(defined, F.col("_gain") / positives).alias("average_precision"),
        F.when(
            defined, F.col("_order").cast("double") / (2 * positives.cast("double") * others.cast("double"))
        ).alias("auroc"),
    )


def brier(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean squared error of probabilities; summed in integers, divided once."""
    score = F.col("score")
    squared = F.col("pos") * (SCALE - score) * (SCALE - score) + (F.col("n") - F.col("pos")) * score * score
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.sum(squared.cast("decimal(38,0)")).alias("_s")
    ).select(*keys, "n_rows", (F.col("_s").cast("double") / (SCALE * SCALE) / F.col("n_rows")).alias("brier"))


def calibration_bins(counts: DataFrame, keys: Sequence[str], bins: int = CALIBRATION_BINS) -> DataFrame:
    """Equal-width bins with their row count, score sum and positives."""
    at = F.least(F.floor(F.col("score") * bins / SCALE), F.lit(bins - 1)).cast("long")
    return counts.groupBy(*keys, at.alias("bin")).agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("score") * F.col("n")).alias("score_sum"),
        F.sum("pos").alias("n_positive"),
    )


def expected_calibration_error(counts: DataFrame, keys: Sequence[str], bins: int = CALIBRATION_BINS) -> DataFrame:
    """Row-weighted absolute gap between mean score and positive rate over the bins."""
    gap = F.abs(F.col("score_sum") - SCALE * F.col("n_positive"))
    return calibration_bins(counts, keys, bins).groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"),
        (F.sum(gap).cast("double") / SCALE / F.sum("n_rows")).alias("ece"),
    )


def class_recall(counts: DataFrame, keys: Sequence[str], threshold: int = SCALE // 2) -> DataFrame:
    """Recall of each class at a fixed threshold; null when the class is absent."""
    hit = F.col("score") >= threshold
    negatives = F.col("n") - F.col("pos")
    facts = counts.groupBy(*keys).agg(
        F.sum("pos").alias("_p"),
        F.sum(negatives).alias("_q"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(~hit, negatives).otherwise(0)).alias("_tn"),
    )
    return facts.select(
        *keys,
        F.when(F.col("_p") > 0, F.col("_tp") / F.col("_p")).alias("regression_recall"),
        F.when(F.col("_q") > 0, F.col("_tn") / F.col("_q")).alias("non_regression_recall"),
    )


def recall_at_fpr(counts: DataFrame, block: str, budget: float = BENIGN_FPR) -> DataFrame:
    """Per fold: the lowest validation threshold within the false-positive budget, applied once to test.

    ``counts`` are histograms per outer block, so only counts are repeated per fold.
    """
    roles = merged(fold_roles(counts, block), ["fold_id", "role"])
    steps = cumulative(roles.where("role = 'validation'"), ["fold_id"])
    negatives = (
        roles.where("role = 'validation'").groupBy("fold_id").agg(F.sum(F.col("n") - F.col("pos")).alias("_neg"))
    )
    within = steps.join(negatives, "fold_id").where(F.col("taken") - F.col("tp") <= budget * F.col("_neg"))
    thresholds = within.groupBy("fold_id").agg(F.min("score").alias("threshold"))
    test = roles.where("role = 'test'").join(thresholds, "fold_id", "left")
    hit = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    negative = F.col("n") - F.col("pos")
    facts = test.groupBy("fold_id").agg(
        F.max("threshold").alias("threshold"),
        F.sum("pos").alias("_p"),
        F.sum(negative).alias("_q"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("_tp"),
        F.sum(F.when(hit, negative).otherwise(0)).alias("_fp"),
    )
    return facts.select(
        "fold_id",
        "threshold",
        F.when(F.col("_p") > 0, F.col("_tp") / F.col("_p")).alias("test_recall"),
        F.when(F.col("_q") > 0, F.col("_fp") / F.col("_q")).alias("test_fpr"),
    )


def draws(resample: int, clusters: int, seed: int) -> np.ndarray:
    """How often each cluster is drawn: md5 draws with replacement, the same for every comparison."""
    picked = [int(hashlib.md5(f"{seed}:{resample}:{draw}".encode()).hexdigest()[:8], 16) % clusters for draw in range(clusters)]
    return np.bincount(picked, minlength=clusters)


def weighed_precision(cluster: np.ndarray, score: np.ndarray, pos: np.ndarray, n: np.ndarray, clusters: int, resamples: Sequence[int], seed: int) -> list:
    """``(resample, average precision)`` of one model. Memory follows the rows of the histogram, not clusters x scores."""
    order = np.argsort(-score, kind="stable")
    cluster, score, pos, n = (a[order] for a in (cluster, score, pos, n))
    starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
    out = []
    for resample in resamples:
        weight = draws(resample, clusters, seed)[cluster]
        hits, rows = np.add.reduceat(weight * pos, starts), np.add.reduceat(weight * n, starts)
        taken = np.cumsum(rows)
        positives = hits.sum()
        if 0 < positives < taken[-1]:
            gain = (hits * (np.cumsum(hits) / np.maximum(taken, 1))).sum()
            out.append((resample, gain / positives))
        else:
            out.append((resample, None))
    return out


def bootstrap_precision(
    counts: DataFrame, models: Sequence[str], resamples: int = RESAMPLES, seed: int = BOOTSTRAP_SEED
) -> DataFrame:
    """``(resample, <model>...)``: average precision of each model on each cluster resample.

    ``counts`` holds ``(cluster, model, score, pos, n)`` with clusters numbered from zero. Resamples are cut into chunks; a
    task takes one model's histogram (a row for each cluster and score that occur together) and weighs them by each resample's draws.
    """
    clusters = counts.agg(F.max("cluster") + 1).first()[0]
    chunks = -(-resamples // RESAMPLE_CHUNK)
    spread = counts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["chunk"].iloc[0]) * RESAMPLE_CHUNK
        chosen = range(first, min(first + RESAMPLE_CHUNK, resamples))
        out = weighed_precision(*[pdf[c].to_numpy() for c in ("cluster", "score", "pos", "n")], clusters, chosen, seed)
        return pd.DataFrame(out, columns=["resample", "value"]).assign(model=pdf["model"].iloc[0])

    scored = spread.groupBy("chunk", "model").applyInPandas(weigh, "resample long, value double, model string")
    return scored.groupBy("resample").agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(m) for m in models])


def bootstrap_intervals(resampled: DataFrame, subject: str, comparators: Sequence[str]) -> DataFrame:
    """Percentile intervals (95%) of subject minus comparator, in millionths.

    ``(comparison, n_resamples, n_undefined, lower_ppm, upper_ppm)``; undefined resamples leave no
    interval.
    """
    entries = F.array(
        *[
            F.struct(
                F.lit(f"{subject}-{other}").alias("comparison"),
                F.rint((F.col(subject) - F.col(other)) * 1_000_000).cast("long").alias("diff"),
            )
            for other in comparators
        ]
    )
    # one row per resample and comparison; kept, because counts and ranks both read it
    diffs = cut_lineage(resampled.select(F.explode(entries).alias("d")).select("d.*"))
    counts = diffs.groupBy("comparison").agg(
        F.count(F.lit(1)).alias("n_resamples"), F.count_if(F.col("diff").isNull()).alias("n_undefined")
    )
    report = percentile_report(
        diffs.where("diff is not null"),
        ["comparison"],
        "diff",
        {"lower_ppm": 25, "upper_ppm": 975},
        F.floor(F.col("diff") / 1024),
    ).select("comparison", "lower_ppm", "upper_ppm")
    joined = counts.join(report, "comparison", "left")
    sure = F.col("n_undefined") == 0
    return joined.select(
        "comparison",
        "n_resamples",
        "n_undefined",
        F.when(sure, F.col("lower_ppm")).alias("lower_ppm"),
        F.when(sure, F.col("upper_ppm")).alias("upper_ppm"),
    )


def claim_gate(intervals: DataFrame, gates: DataFrame) -> DataFrame:
    """One row: every lower bound above zero, nothing undefined, every eligibility gate passed."""
    gates_passed = gates.agg(F.coalesce(F.bool_and("passed"), F.lit(False))).scalar()
    bounds = intervals.agg(
        F.coalesce(F.bool_and(F.coalesce(F.col("lower_ppm") > 0, F.lit(False))), F.lit(False)).alias("bounds_positive"),
        F.coalesce(F.bool_and(F.col("n_undefined") == 0), F.lit(False)).alias("all_defined"),
    ).withColumn("gates_passed", gates_passed)
    return bounds.withColumn("claim", F.col("bounds_positive") & F.col("all_defined") & F.col("gates_passed"))


def score_parity(
    left: DataFrame, right: DataFrame, keys: Sequence[str], score: str, limit: float = PARITY_LIMIT
) -> DataFrame:
    """Largest absolute difference of two score tables, and rows present on one side only."""
    a = left.select(*keys, F.col(score).alias("_a"), F.lit(1).alias("_ina"))
    b = right.select(*keys, F.col(score).alias("_b"), F.lit(1).alias("_inb"))
    joined = a.join(b, list(keys), "full")
    return joined.agg(
        F.count_if(F.col("_ina").isNotNull() & F.col("_inb").isNotNull()).alias("n_compared"),
        F.count_if(F.col("_ina").isNull() | F.col("_inb").isNull()).alias("n_unmatched"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_difference"),
    ).withColumn("passed", (F.col("n_unmatched") == 0) & (F.col("max_difference") <= limit))


def temporal_views(rows: DataFrame, key: str, at: str, measures: Mapping[str, Column]) -> DataFrame:
    """``(key, view, n_checkpoints, measures...)`` for the first, the last and all checkpoints."""
    values = F.struct(*[value.alias(name) for name, value in measures.items()])
    facts = rows.groupBy(key).agg(
        F.min_by(values, at).alias("first"),
        F.max_by(values, at).alias("last"),
        F.struct(*[F.sum(value).alias(name) for name, value in measures.items()]).alias("all"),
        F.count(F.lit(1)).alias("n"),
    )
    one = F.lit(1).cast("long")

    def view(name: str, source: str, n: Column) -> Column:
        return F.struct(
            F.lit(name).alias("view"),
            n.alias("n_checkpoints"),
            *[F.col(f"{source}.{m}").cast("long").alias(m) for m in measures],
        )

    views = F.array(
        view("initial_only", "first", one),
        view("post_primary_action_only", "last", one),
        view("all_checkpoints", "all", F.col("n")),
    )
    return facts.select(key, F.explode(views).alias("v")).select(key, "v.*")
