"""Grouped cross-fit logits of two experts and the late logistic stacker over them."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.canonical import hash_bucket
from pairwright.operators.splits import ROLE_SCHEDULE, fold_roles
from pairwright.session import cut_lineage

REGULARISATION = 0.1
LOGIT_LIMIT = 30.0


def _fit(rows: DataFrame, inputs: Sequence[str], label: str):
    assembled = VectorAssembler(inputCols=list(inputs), outputCol="_x").transform(rows)
    return LogisticRegression(
        featuresCol="_x", labelCol=label, regParam=REGULARISATION, elasticNetParam=0.0, maxIter=50
    ).fit(assembled)


def _logits(model, rows: DataFrame, inputs: Sequence[str], out: str, kept: Sequence[str]) -> DataFrame:
    assembled = VectorAssembler(inputCols=list(inputs), outputCol="_x").transform(rows)
    # a fold with one class gives infinite logits
    raw = F.least(F.greatest(vector_to_array(F.col("rawPrediction"))[1], F.lit(-LOGIT_LIMIT)), F.lit(LOGIT_LIMIT))
    return model.transform(assembled).select(*kept, raw.alias(out))


def crossfit_stacker(
    train: DataFrame,
    apply_to: DataFrame,
    key: str,
    group: str,
    label: str,
    experts: Sequence[Sequence[str]],
    folds: int = 3,
) -> DataFrame:
    """``(key, probability)`` for ``apply_to``, which must not hold training rows: the experts have seen their labels.

    Stacker inputs are out-of-fold logits, with folds split by ``group``; the experts are then refit on
    all training rows. Fits are distributed; the loop runs over folds and experts only.
    """
    train = cut_lineage(train.withColumn("_fold", hash_bucket(F.col(group), folds)))
    stacked, applied = [], apply_to
    for number, inputs in enumerate(experts):
        out = f"logit_{number}"
        parts = [
            _logits(_fit(train.where(F.col("_fold") != fold), inputs, label), train.where(F.col("_fold") == fold), inputs, out, [key])
            for fold in range(folds)
        ]
        stacked.append(reduce(DataFrame.unionByName, parts))
        refit = _fit(train, inputs, label)
        applied = _logits(refit, applied, inputs, out, applied.columns)
    names = [f"logit_{number}" for number in range(len(experts))]
    inputs = train.select(key, label)
    for logits in stacked:
        inputs = inputs.join(logits, key)
    stacker = _fit(cut_lineage(inputs), names, label)
    assembled = VectorAssembler(inputCols=names, outputCol="_x").transform(applied)
    return stacker.transform(assembled).select(key, vector_to_array(F.col("probability"))[1].alias("probability"))


def outer_predictions(
    rows: DataFrame, block: str, valid: Column, key: str, group: str, label: str, experts: Sequence[Sequence[str]]
) -> DataFrame:
    """``(fold_id, role, key, probability)``: per outer fold the validation and test rows, predicted from its train rows alone.

    Only ``valid`` rows are learnt from; all are predicted. Folds are fitted side by side on one materialised table.
    """
    placed = cut_lineage(fold_roles(rows, block))

    def predict(fold: str) -> DataFrame:
        mine = placed.where(F.col("fold_id") == fold)
        train = mine.where((F.col("role") == "train") & valid)
        rest = mine.where("role <> 'train'")
        return crossfit_stacker(train, rest, key, group, label, experts).join(rest.select(key, "fold_id", "role"), key)

    folds = [fold for fold, *_ in ROLE_SCHEDULE]
    with ThreadPoolExecutor(len(folds)) as pool:
        parts = list(pool.map(predict, folds))
    return reduce(DataFrame.unionByName, parts).select("fold_id", "role", key, "probability")
