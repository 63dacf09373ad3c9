"""Trained predictors for walk-forward folds, on pyspark.ml.

Every fit and every prediction is distributed. Folds and models (a handful of each) are
independent, so several are fitted at a time; a fold's training rows lie in as few
partitions as their number asks for, since tree models run very many short jobs over them.
A model that fails on a fold is reported and the others go on.

Defined cases: null or missing inputs count as 0; rows without a target don't train; a fold
without training or test rows has no predictions.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Training rows a task works on (parameter).
ROWS_A_TASK = 50_000

#: Columns of the design matrix (fixed values: the names of this engine's features).
NUMERIC = [
    "eps_surprise", "eps_surprise_pct", "rev_surprise_pct", "sue", "beat", "beat_streak", "prev_surprise_pct", "mom_1m", "mom_3m", "mom_6m",
    "dist_high", "rv_3m", "downside_vol_3m", "volume_surprise", "short_term_reversal", "market_cap_at_event",
]


@dataclass(frozen=True)
class Trained:
    """A regression model: a name and a function that makes its estimator from the training rows."""

    name: str
    make: Callable[[DataFrame], object]
    rounds: int = 1  # about how long a fit takes, to begin with the longest


def elastic_net(alpha: float, mix: float):
    """Elastic net with penalties per unit of the target: Spark divides the quadratic part by the target's deviation, so it is scaled back."""

    def make(train: DataFrame):
        spread = train.agg(F.stddev_pop("label")).first()[0] or 1.0
        first, second = alpha * mix, alpha * (1 - mix)
        total = first + second * spread
        return LinearRegression(featuresCol="x", regParam=total, elasticNetParam=first / total if total else 0.0, standardization=False)

    return make


def standard_models(trees: int = 200, rounds: int = 300, seed: int = 42) -> list[Trained]:
    return [
        Trained("linear", lambda _: LinearRegression(featuresCol="x", solver="normal", regParam=0.0)),
        Trained("elastic_net", elastic_net(0.01, 0.5)),
        Trained("random_forest", lambda _: RandomForestRegressor(featuresCol="x", numTrees=trees, maxDepth=6, minInstancesPerNode=20, featureSubsetStrategy="all", maxMemoryInMB=512, seed=seed)),
        Trained("boosted_trees", lambda _: GBTRegressor(featuresCol="x", maxIter=rounds, stepSize=0.03, maxDepth=5, minInstancesPerNode=20, seed=seed), rounds),
    ]


def design(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds the vector ``raw`` of the given columns that exist, null as 0."""
    have = [c for c in columns if c in rows.columns]
    zero = rows.select(*[c for c in rows.columns if c not in have], *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in have])
    return VectorAssembler(inputCols=have, outputCol="raw").transform(zero)


def walk_forward(members: DataFrame, target: str, models: list[Trained], columns: list[str] | None = None, threads: int = 8) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    """Test predictions (model, fold, event_id, prediction, actual) of every fold and model, and failures (model, fold, message).

    ``members``: rows with fold and role, as of ``fold_members``. Scaling is fitted on training rows only.
    """
    spark = members.sparkSession
    rows = design(members, columns or NUMERIC).select("event_id", "fold", "role", "raw", F.col(target).cast("double").alias("label")).persist()
    counted = rows.groupBy("fold").agg(F.count_if((F.col("role") == "train") & F.col("label").isNotNull()).alias("train"), F.count_if(F.col("role") == "test").alias("test"))
    folds = [(r["fold"], r["train"]) for r in counted.orderBy("fold").collect() if r["train"] and r["test"]]  # a handful

    def scaled(fold: tuple[str, int]) -> tuple[str, DataFrame, DataFrame]:
        name, n = fold
        train = rows.where((F.col("fold") == name) & (F.col("role") == "train") & F.col("label").isNotNull())
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True).fit(train)
        seen = scaler.transform(train).select("x", "label").coalesce(-(-n // ROWS_A_TASK)).persist()
        return name, seen, scaler.transform(rows.where((F.col("fold") == name) & (F.col("role") == "test")))

    def fitted(job: tuple) -> tuple[DataFrame | None, tuple[str, str, str] | None]:
        (fold, seen, asked), model = job
        try:
            got = model.make(seen).fit(seen).transform(asked)
        except Exception as error:  # noqa: BLE001 - one model's failure must not end the run
            return None, (model.name, fold, str(error))
        return got.select(F.lit(model.name).alias("model"), F.lit(fold).alias("fold"), "event_id", "prediction", F.col("label").alias("actual")), None

    with ThreadPoolExecutor(threads) as pool:
        ready = list(pool.map(scaled, folds))
        # the longest fits first
        jobs = sorted(((f, m) for m in models for f in ready), key=lambda j: j[1].rounds, reverse=True)
        done = list(pool.map(fitted, jobs))
    for _, seen, _ in ready:
        seen.unpersist()
    empty = spark.createDataFrame([], "model string, fold string, event_id string, prediction double, actual double")
    return reduce(DataFrame.unionByName, [got for got, _ in done if got is not None], empty), [f for _, f in done if f]


#: Calls that would mix future rows into training (fixed values).
SHUFFLERS = {"randomSplit", "sampleBy", "train_test_split", "KFold", "ShuffleSplit", "StratifiedKFold", "GroupKFold", "cross_val_score", "CrossValidator", "TrainValidationSplit"}


def shuffling_calls(source: str) -> list[str]:
    """Names of row-shuffling splitters that a Python source calls."""
    names = (getattr(n.func, "attr", getattr(n.func, "id", "")) for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Call))
    return sorted({n for n in names if n in SHUFFLERS})


def feature_subset(rows: DataFrame, keep: list[str], always: list[str]) -> DataFrame:
    """The rows with only the kept features and the columns every run needs."""
    return rows.select(*dict.fromkeys([c for c in [*always, *keep] if c in rows.columns]))
