"""Ranking, forecast and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoveil.functions import vectors as vec
from chronoveil.operators.clean import group_stats
from chronoveil.operators.position import join_null_safe, range_count, running_sum, split_index, value_splits


def ranked_counts(df: DataFrame, keys: Sequence[str], score: str, label: str, parts: int | None = None) -> DataFrame:
    """Positives and negatives per distinct score with the counts strictly below it and the totals of the key.

    Equal scores are merged map-side first. Prefix sums run inside equi-depth score ranges and are stitched with
    one row per range, so neither a global sort in one task nor a group of rows is needed. The number of ranges follows
    the number of rows unless ``parts`` is given.
    """
    parts = parts or range_count(df.count())
    counts = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum(F.col(label).cast("bigint")).alias("_p"), F.sum(1 - F.col(label).cast("bigint")).alias("_n"))
    block = split_index(F.col("_s"), value_splits(df, score, parts)) if parts > 1 else None
    cum = running_sum(counts, keys, ["_s"], block, {"_cp": F.col("_p"), "_cn": F.col("_n")})
    if not keys:
        return cum.withColumns({"_tp": counts.agg(F.sum("_p")).scalar(), "_tn": counts.agg(F.sum("_n")).scalar()})
    totals = counts.groupBy(*keys).agg(F.sum("_p").alias("_tp"), F.sum("_n").alias("_tn"))
    return join_null_safe(cum, totals, keys)


def ranking_metrics(df: DataFrame, keys: Sequence[str], score: str, label: str, parts: int | None = None) -> DataFrame:
    """AUROC with tied ranks and average precision by the step rule, in one pass over the ranked counts."""
    r = ranked_counts(df, keys, score, label, parts)
    p, n, total_p, total_n = (F.col(c) for c in ("_p", "_n", "_tp", "_tn"))
    below_n, below_p = F.col("_cn") - n, F.col("_cp") - p
    wins = F.sum(p * (below_n + n / 2.0)) / F.max(total_p * total_n)
    at_least_p, at_least = total_p - below_p, total_p - below_p + total_n - below_n
    ap = F.sum(p / total_p * at_least_p / at_least)
    both = F.max((total_p > 0) & (total_n > 0))
    return r.groupBy(*keys).agg(F.when(both, wins).alias("auroc"), F.when(F.max(total_p) > 0, ap).alias("ap")).select(
        *keys, "auroc", "ap")


def f1_at(df: DataFrame, keys: Sequence[str], score: str, label: str, threshold: float) -> DataFrame:
    """Binary F1 of score > threshold; 0 when undefined."""
    hit, real = F.col(score) > threshold, F.col(label) == 1
    tp, fp, fn = F.count_if(hit & real), F.count_if(hit & ~real), F.count_if(~hit & real)
    return df.groupBy(*keys).agg(F.coalesce(F.try_divide(2.0 * tp, (2 * tp + fp + fn).cast("double")), F.lit(0.0)).alias("f1"))


def forecast_metrics(df: DataFrame, keys: Sequence[str], true: str, pred: str) -> DataFrame:
    """MAE, MSE, RMSE, MAPE, MSPE and RSE. A zero target makes the percentage errors infinite (or NaN at 0/0)."""
    t, p = F.col(true), F.col(pred)
    err = p - t
    ratio = F.when(t != 0, err / F.when(t != 0, t)).when(err == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    out = df.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(ratio)).alias("mape"), F.avg(ratio * ratio).alias("mspe"),
        F.sqrt(F.sum(err * err)).alias("_e"), F.sqrt(F.var_pop(t) * F.count(t)).alias("_d"))
    return out.withColumn("rse", F.try_divide("_e", "_d")).drop("_e", "_d")


def scaled_correlation(df: DataFrame, keys: Sequence[str], cell: Sequence[str], true: str, pred: str,
                       cells: int | None = None) -> DataFrame:
    """0.01 * mean over cells of sum(dt*dp) / (sqrt(sum(dt^2 dp^2)) + 1e-12); not a Pearson correlation.

    ``cells`` is the number of (key, cell) groups where it is a parameter (horizon times channels)."""
    centred = group_stats(df, [*keys, *cell], {"_t": F.avg(true), "_p": F.avg(pred)}, groups=cells)
    dt, dp = F.col(true) - F.col("_t"), F.col(pred) - F.col("_p")
    per = centred.groupBy(*keys, *cell).agg(
        (F.sum(dt * dp) / (F.sqrt(F.sum(dt * dt * dp * dp)) + 1e-12)).alias("_u"))
    return per.groupBy(*keys).agg((0.01 * F.avg("_u")).alias("corr"))


def lp_losses(df: DataFrame, x: str, y: str, p: float, d: int = 2) -> DataFrame:
    """Relative and absolute Lp distance of two vectors per row (uniform mesh of the vector's length)."""
    diff = vec.p_norm(vec.subtract(F.col(x), F.col(y)), p)
    h = F.lit(1.0) / (F.size(x) - 1.0)
    return df.withColumn("rel", diff / vec.p_norm(F.col(y), p)).withColumn("abs", F.pow(h, F.lit(d / p)) * diff)


def reduce_losses(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.sum(c).alias(f"{c}_sum")]
    return df.groupBy(*keys).agg(*aggs)


def elementwise_mse(df: DataFrame, keys: Sequence[str], true: str, pred: str) -> DataFrame:
    err = F.col(true) - F.col(pred)
    return df.groupBy(*keys).agg((F.sum(err * err) / F.count(err)).alias("mse"), F.count(err).alias("elements"))


def batch_weighted(df: DataFrame, keys: Sequence[str], batch: Column, loss: str) -> DataFrame:
    """Mean of batch means weighted by batch size."""
    per = df.groupBy(*keys, batch.alias("_b")).agg(F.avg(loss).alias("_l"), F.count(loss).alias("_n"))
    return per.groupBy(*keys).agg((F.sum(F.col("_l") * F.col("_n")) / F.sum("_n")).alias("loss"),
                                  F.count(F.lit(1)).alias("batches"))


def confusion(df: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_report(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as truth or prediction; undefined values are 0."""
    n = F.col("n")
    sides = F.array(
        F.struct(F.col("truth").alias("label"), n.alias("t"), F.lit(0).cast("bigint").alias("p"),
                 F.when(F.col("truth") == F.col("pred"), n).otherwise(F.lit(0)).alias("tp")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("t"), n.alias("p"),
                 F.lit(0).cast("bigint").alias("tp")))
    per = conf.select(*keys, F.inline(sides)).groupBy(*keys, "label").agg(
        F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("tp").alias("tp"))

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    return per.select(*keys, "label", "support", "tp", safe(F.col("tp"), F.col("predicted")).alias("precision"),
                      safe(F.col("tp"), F.col("support")).alias("recall"),
                      safe(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"))


def class_metrics(conf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, macro F1 and support-weighted F1."""
    per = class_report(conf, keys)
    s = F.col("support")
    return per.groupBy(*keys).agg((F.sum("tp") / F.sum(s)).alias("accuracy"), F.avg("f1").alias("macro_f1"),
                                  (F.sum(F.col("f1") * s) / F.sum(s)).alias("weighted_f1"))


def confusion_matrix(conf: DataFrame, labels: Sequence) -> DataFrame:
    """Wide confusion matrix: one row per true class."""
    return conf.groupBy("truth").pivot("pred", list(labels)).agg(F.sum("n")).fillna(0)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log softmax(logits)[label] with a 0-based label."""
    return vec.logsumexp(logits) - F.element_at(logits, (label + 1).cast("int"))
