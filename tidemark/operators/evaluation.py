"""Walk-forward folds, baselines, grouped prediction metrics, bootstrap intervals, scenario sweeps.

Predictions are rows (model, fold, event_id, prediction, actual). All metrics of all groups come
from grouped aggregations over exact ranks (``ranks``), so no group has to fit one task.

Defined cases: rows with a null or non-finite prediction or actual take no part; a constant
prediction or actual has null correlations; fewer than five rows give only n, fewer than ten
no spread; one class only gives null classification metrics; empty input gives no groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ranks import HOT_ROWS, bucketed, exact_quantiles, with_ranks


def plus_years(day: date, years: int) -> date:
    try:
        return day.replace(year=day.year + years)
    except ValueError:
        return day.replace(year=day.year + years, day=28)


def make_folds(spark: SparkSession, train_start: str, train_end: str, val_start: str, val_end: str, test_start: str, last_end: str, years: int = 1) -> DataFrame:
    """Expanding folds: fold, train_start, train_end, val_start, val_end, test_start, test_end (dates). A few rows, made on the driver."""
    a, b, c, d, e, z = map(date.fromisoformat, (train_start, train_end, val_start, val_end, test_start, last_end))
    rows = []
    while e <= z:
        f = min(plus_years(e, years) - timedelta(days=1), z)
        rows.append((f"test_{e.year}", a, b, c, d, e, f))
        b, c, d, e = d, e, f, plus_years(e, years)
    return spark.createDataFrame(rows, "fold string, train_start date, train_end date, val_start date, val_end date, test_start date, test_end date")


def fold_members(rows: DataFrame, day: str, folds: DataFrame, roles: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """Rows with fold and role, once per fold and role they belong to (bounds inclusive)."""
    belongs = F.array_compact(F.array(*[F.when(F.col(day).between(F.col(f"{r}_start"), F.col(f"{r}_end")), F.lit(r)) for r in roles]))
    joined = rows.join(F.broadcast(folds), F.col(day).between(F.least(*[F.col(f"{r}_start") for r in roles]), F.greatest(*[F.col(f"{r}_end") for r in roles])))
    return joined.select(*rows.columns, "fold", F.explode(belongs).alias("role"))


def baseline_predictions(members: DataFrame, target: str, model: str, x: str = "eps_surprise_pct", sector: str = "sector") -> DataFrame:
    """Test predictions of a baseline fitted on each fold's training rows: fold, event_id, prediction, actual.

    unconditional_mean and event_day_unconditional: the training mean; surprise: x; prior: prev_surprise_pct; surprise_decile: the share of
    training deciles of x that are not above x; sector_relative: x less its sector's training mean.
    """
    train, test = members.where("role = 'train'"), members.where("role = 'test'")
    # folds are few: one row each
    fitted = train.groupBy("fold").agg(F.avg(target).alias("_mean"), F.avg(x).alias("_x"))
    seen = test.join(F.broadcast(fitted), "fold")
    zero = F.lit(0.0)
    if model == "surprise_decile":
        cuts = exact_quantiles(train, ["fold"], x, [i / 10 for i in range(1, 10)], "_cuts")
        seen = seen.join(F.broadcast(cuts), "fold", "left")
    if model == "sector_relative":
        means = train.where(F.col(sector).isNotNull()).groupBy("fold", sector).agg(F.avg(x).alias("_sector"))
        seen = seen.join(means, ["fold", sector], "left")
    value = {
        "unconditional_mean": lambda: F.col("_mean"),
        "event_day_unconditional": lambda: F.col("_mean"),
        "surprise": lambda: F.coalesce(x, zero),
        "prior": lambda: F.coalesce("prev_surprise_pct", zero),
        "surprise_decile": lambda: F.when(F.col(x).isNull(), zero).otherwise(F.size(F.filter("_cuts", lambda c: c <= F.col(x))) / 10.0),
        "sector_relative": lambda: F.coalesce(F.col(x) - F.coalesce("_sector", "_x"), zero),
    }[model]()
    return seen.select("fold", "event_id", value.cast("double").alias("prediction"), F.col(target).alias("actual"))


def usable(predictions: DataFrame) -> DataFrame:
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return predictions.where(fine("prediction") & fine("actual"))


def pearson(x: str, y: str) -> Column:
    """Correlation of two columns, null if either hardly varies (rounding noise of a constant counts as none)."""
    flat = lambda c: F.stddev_pop(c) <= 1e-12 * (F.abs(F.avg(c)) + 1e-300)
    return F.when(~flat(x) & ~flat(y), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def group_metrics(predictions: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """n, mae, rmse, pearson, spearman, top_minus_bottom, roc_auc, brier, ece per group.

    The top fifth are the predictions at or above the linear 80 % quantile, the bottom fifth those at or below the
    20 % quantile; which these are follows from the ranks alone.
    """
    ranked = with_ranks(usable(predictions), by, {"_p": "prediction", "_a": "actual"}, hot_rows)
    ranked = ranked.withColumns({"_rp": (F.col("_p_low") + F.col("_p_high")) / 2.0, "_ra": (F.col("_a_low") + F.col("_a_high")) / 2.0, "_y": (F.col("actual") > 0).cast("int"), "_prob": 1 / (1 + F.exp(-F.col("prediction")))})
    error = F.col("prediction") - F.col("actual")
    last = F.col("_n") - 1
    top, low = F.col("_p_high") > F.ceil(last * 4 / 5), F.col("_p_low") - 1 <= F.floor(last / 5)
    # by calibration bin first: one pass, and a group is never one task's work
    parts = ranked.withColumn("_bin", F.least(F.lit(9), F.floor(F.col("_prob") * 10))).groupBy(*by, "_bin").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_prob").alias("_p"), F.avg("_y").alias("_m"), F.sum(F.abs(error)).alias("_abs"), F.sum(error * error).alias("_sq"), F.sum("_y").alias("_pos"),
        F.sum(F.when(F.col("_y") == 1, F.col("_rp"))).alias("_ranks"), F.sum((F.col("_prob") - F.col("_y")) * (F.col("_prob") - F.col("_y"))).alias("_brier"),
        F.sum(F.when(top, F.col("actual"))).alias("_top"), F.count_if(top).alias("_tops"), F.sum(F.when(low, F.col("actual"))).alias("_low"), F.count_if(low).alias("_lows"),
    )
    n, pos = F.col("n"), F.col("_pos")
    total = lambda c: F.sum(c)
    core = parts.groupBy(*by).agg(
        total("_n").alias("n"), (total("_abs") / total("_n")).alias("mae"), F.sqrt(total("_sq") / total("_n")).alias("rmse"), total("_pos").alias("_pos"), total("_ranks").alias("_ranks"), (total("_brier") / total("_n")).alias("brier"),
        (F.try_divide(total("_top"), total("_tops")) - F.try_divide(total("_low"), total("_lows"))).alias("top_minus_bottom"), (F.sum(F.col("_n") * F.abs(F.col("_p") - F.col("_m"))) / total("_n")).alias("ece"),
    )
    related = ranked.groupBy(*by).agg(pearson("prediction", "actual").alias("pearson"), pearson("_rp", "_ra").alias("spearman"))
    full = core.join(related, by)
    auc = F.try_divide(F.col("_ranks") - pos * (pos + 1) / 2.0, (pos * (n - pos)).cast("double"))
    both = (pos > 0) & (pos < n) & F.col("pearson").isNotNull()
    keep = lambda c, ok: F.when(ok & (n >= 5), c)
    some = F.lit(True)
    return full.select(
        *by, "n",
        *[keep(F.col(c), some).alias(c) for c in ("mae", "rmse", "pearson", "spearman")],
        keep(F.col("top_minus_bottom"), n >= 10).alias("top_minus_bottom"),
        keep(auc, both).alias("roc_auc"), keep(F.col("brier"), both).alias("brier"), keep(F.col("ece"), both).alias("ece"),
    )


def pooled_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics per model over all folds, with n_total and the actuals' mean over their deviation."""
    every = predictions.groupBy("model").agg(F.count(F.lit(1)).alias("n_total"), (F.avg("actual") / (F.coalesce(F.stddev_samp("actual"), F.lit(0.0)) + 1e-9)).alias("effect_size"))
    return every.join(group_metrics(predictions, ["model"]), "model", "left")


def resampling(n: int, draws: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of each draw over n ordered rows as (first row, row after the last), and all these positions in order. A draw has n rows."""
    size = max(5, n // 20)
    first = np.random.default_rng(seed).integers(0, max(1, n - size + 1), size=(draws, n // size + 1))
    length = np.full(first.shape, size)
    length[:, -1] = n - (n // size) * size
    return first, first + length, np.unique(np.concatenate([first.ravel(), (first + length).ravel()]))


def block_sums(draws: int, seed: int):
    """Sums of each stretch of rows between two block ends, per batch; only these leave a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_, ends = None, np.array([], dtype="int64")
        for batch in batches:
            frame = batch.to_pandas()
            out = []
            for (key, n), rows in frame.groupby(["key", "n"], sort=False):
                if (key, n) != key_:  # a task's rows come group by group
                    key_, ends = (key, n), resampling(int(n), draws, seed)[2]
                stretch = np.searchsorted(ends, rows["row"].to_numpy() - 1, "right")
                x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
                sums = pd.DataFrame({"stretch": stretch, "bin": rows["bin"].to_numpy(), "c": 1.0, "x": x, "y": y, "xy": x * y, "xx": x * x, "yy": y * y}).groupby(["stretch", "bin"], as_index=False).sum()
                out.append(sums.assign(key=key, n=n))
            if out:
                whole = pd.concat(out)[["key", "n", "stretch", "bin", "c", "x", "y", "xy", "xx", "yy"]]
                yield pa.RecordBatch.from_pandas(whole.astype({"n": "int64", "stretch": "int32", "bin": "int32"}), preserve_index=False)

    return run


BINS = 1024


def block_bootstrap(predictions: DataFrame, by: list[str], order: list[str], draws: int = 200, seed: int = 42, metric: str = "pearson") -> DataFrame:
    """Block-bootstrap 95 % interval of the Pearson correlation, or of ``top_minus_bottom``, per group: low, high.

    Rows are numbered in ``order`` (a fold and an id), and every draw takes blocks of neighbouring rows. A draw's
    statistic follows from the sums between the ends of blocks (at most 2 x 21 per draw), so rows are added up
    where they lie and a group's task gets these sums only. For ``top_minus_bottom`` the sums are kept by
    prediction in BINS equal bins of rank; with more rows than bins the bin a quantile falls into counts as a whole
    on its side. Null with fewer than 20 rows or without variation.
    """
    if metric not in ("pearson", "top_minus_bottom"):
        raise ValueError(f"unknown metric {metric}")
    kept = usable(predictions).select(*dict.fromkeys([*by, *order, "prediction", "actual"]))
    if len(order) == 1:
        kept, order = kept.withColumn("_fold", F.lit(0)), ["_fold", *order]
    # rows before each fold of a group: groups x folds rows
    folds = kept.groupBy(*by, order[0]).agg(F.count(F.lit(1)).alias("_rows"), F.sum("prediction").alias("_sx"), F.sum("actual").alias("_sy"))
    whole = Window.partitionBy(*by)
    sofar = whole.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)
    placed = folds.select(
        *by, order[0], F.coalesce(F.sum("_rows").over(sofar), F.lit(0)).alias("_behind"), F.sum("_rows").over(whole).alias("n"),
        (F.sum("_sx").over(whole) / F.sum("_rows").over(whole)).alias("_mx"), (F.sum("_sy").over(whole) / F.sum("_rows").over(whole)).alias("_my"),
    )
    rows = kept.join(placed, [*by, order[0]])
    if metric == "top_minus_bottom":
        rows = with_ranks(rows, by, {"_p": "prediction"}).withColumn("bin", F.when(F.col("n") <= BINS, F.col("_p_low") - 1).otherwise(F.floor((F.col("_p_low") - 1) * BINS / F.col("n"))).cast("int"))
    else:
        rows = rows.withColumn("bin", F.lit(0))
    number = F.row_number().over(Window.partitionBy(*by, order[0]).orderBy(*order[1:])) + F.col("_behind")
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    centred = rows.where("n >= 20").select(key.alias("key"), "n", number.alias("row"), "bin", (F.col("prediction") - F.col("_mx")).alias("x"), (F.col("actual") - F.col("_my")).alias("y"))
    sums = centred.mapInArrow(block_sums(draws, seed), "key string, n long, stretch int, bin int, c double, x double, y double, xy double, xx double, yy double")
    sums = sums.groupBy("key", "n", "stretch", "bin").agg(*[F.sum(c).alias(c) for c in ("c", "x", "y", "xy", "xx", "yy")])

    def interval(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(key[1])
        first, after, ends = resampling(n, draws, seed)
        from_, to = np.searchsorted(ends, first), np.searchsorted(ends, after)
        at, bins = rows["stretch"].to_numpy(), rows["bin"].to_numpy()
        width = bins.max() + 1

        def drawn(c: str) -> np.ndarray:
            table = np.zeros((len(ends) + 1, width))
            np.add.at(table, (at, bins), rows[c].to_numpy())
            running = np.cumsum(table, axis=0)
            return np.array([(running[b] - running[a]).sum(axis=0) for a, b in zip(from_, to)])

        if metric == "pearson":
            sx, sy, sxy, sxx, syy = (drawn(c)[:, 0] for c in ("x", "y", "xy", "xx", "yy"))
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            fine = (vx > 1e-12 * sxx) & (vy > 1e-12 * syy)
            value = (sxy - sx * sy / n)[fine] / np.sqrt(vx[fine] * vy[fine])
        else:
            count, total = drawn("c"), drawn("y")
            running = np.cumsum(count, axis=1)
            high, low = (np.array([np.searchsorted(r, k, "right") for r in running]) for k in (-(-(n - 1) * 4 // 5), (n - 1) // 5))
            place = np.arange(width)
            top, bottom = place >= high[:, None], place <= low[:, None]
            value = (total * top).sum(axis=1) / (count * top).sum(axis=1) - (total * bottom).sum(axis=1) / (count * bottom).sum(axis=1)
        ends_ = np.percentile(value, [2.5, 97.5]) if len(value) else [np.nan, np.nan]
        return pd.DataFrame([[key[0], *ends_]])

    got = sums.groupBy("key", "n").applyInPandas(interval, "key string, low double, high double")
    number_or_none = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c)
    groups = placed.select(*by).distinct().withColumn("key", key)
    return groups.join(got, "key", "left").select(*by, number_or_none("low"), number_or_none("high"))


def scenario_sweep(rows: DataFrame, value: str, bucket: str, n: int, levels: list[float], by: list[str] | None = None) -> DataFrame:
    """Per level of a deduction (and ``by``): counts and means of the top and bottom bucket and of their difference, net of it on each side.

    Rows are aggregated once; a level only shifts the means.
    """
    by = by or []
    side = rows.sparkSession.createDataFrame([(float(x),) for x in levels], "level double")
    top, low = F.col(bucket) == n, F.col(bucket) == 1
    each = rows.where(F.col(bucket).isin(1, n)).groupBy(*by).agg(F.count_if(top).alias("n_top"), F.count_if(low).alias("n_bottom"), F.avg(F.when(top, F.col(value))).alias("top_gross"), F.avg(F.when(low, F.col(value))).alias("_bottom"))
    got = each.where("n_top + n_bottom > 0").join(F.broadcast(side))
    got = got.select(*by, "level", "n_top", "n_bottom", "top_gross", (F.col("top_gross") - F.col("level")).alias("top_net"), (-F.col("_bottom") - F.col("level")).alias("bottom_net"))
    return got.withColumn("spread_net", F.col("top_net") + F.col("bottom_net"))


def bucket_summary(rows: DataFrame, value: str, bucket: str, n: int, deduction: float, by: list[str], per_year: float = 4.0) -> DataFrame:
    """Annualised mean, deviation, their ratio and hit rate of the top bucket per ``by``."""
    net = F.col(value) - deduction
    got = rows.where(F.col(bucket) == n).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.avg(net) * per_year).alias("annualized"), (F.stddev_samp(net) * per_year**0.5).alias("volatility"), F.avg((net > 0).cast("int")).alias("hit_rate"))
    return got.withColumn("ratio", F.try_divide("annualized", F.nullif("volatility", F.lit(0.0))))


def positions(events: DataFrame, returns: DataFrame, predictions: DataFrame, horizons: dict[str, str], n: int = 5) -> DataFrame:
    """horizon, model, fold, event_id, prediction, gross and bucket (within horizon, model and fold) of the events that have both a return and a prediction.

    ``horizons`` maps a horizon to its column of ``returns``. All horizons go through one join.
    """
    each = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(c).alias("gross")) for h, c in horizons.items()]))
    told = predictions.where(F.col("prediction").isNotNull()).select("model", "fold", "event_id", "prediction")
    held = events.select("event_id").join(returns.select("event_id", each.alias("r")), "event_id").join(told, "event_id").select("r.horizon", "model", "fold", "event_id", "prediction", "r.gross")
    return bucketed(held.where("gross is not null"), ["horizon", "model", "fold"], "prediction", "event_id", n)


def book_summary(rows: DataFrame, n: int, deduction: float, by: list[str], per_year: float = 4.0) -> DataFrame:
    """Top bucket of ``positions`` per ``by``: n_top, annualized, volatility, ratio, hit_rate, turnover; and the annualised difference of both sides."""
    net, low = F.col("gross") - deduction, -F.col("gross") - deduction
    top, bottom = F.col("bucket") == n, F.col("bucket") == 1
    got = rows.groupBy(*by).agg(
        F.count_if(top).alias("n_top"), F.count_if(bottom).alias("n_bottom"), (F.avg(F.when(top, net)) * per_year).alias("annualized"), (F.stddev_samp(F.when(top, net)) * per_year**0.5).alias("volatility"),
        F.avg(F.when(top, (net > 0).cast("int"))).alias("hit_rate"), ((F.avg(F.when(top, net)) + F.avg(F.when(bottom, low))) * per_year).alias("spread_annualized"),
    )
    return got.withColumn("ratio", F.try_divide("annualized", F.nullif("volatility", F.lit(0.0)))).withColumn("turnover", F.when(F.col("n_top") > 0, F.lit(1.0)))


def book_by_year(rows: DataFrame, folds: DataFrame, n: int, deduction: float, by: list[str]) -> DataFrame:
    """Mean net return of the top bucket per ``by`` and year in which a fold's test begins."""
    years = folds.select("fold", F.year("test_start").alias("year"))
    return rows.where(F.col("bucket") == n).join(F.broadcast(years), "fold").groupBy(*by, "year").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("gross") - deduction).alias("mean_net"))


def fold_buckets(predictions: DataFrame, n: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds the prediction's bucket within its model and fold (ties: event_id)."""
    return bucketed(predictions, ["model", "fold"], "prediction", "event_id", n, hot_rows=hot_rows)


def decay_of_best(metrics: DataFrame) -> DataFrame:
    """Per-fold Pearson of the model whose mean Pearson over folds is highest (ties: model name)."""
    means = metrics.groupBy("model").agg(F.avg("pearson").alias("m")).where("m is not null")
    best = means.agg(F.max_by("model", F.struct("m", "model")).alias("model"))
    return metrics.join(F.broadcast(best), "model").select("model", "fold", "pearson")
