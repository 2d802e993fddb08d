"""Detection and counting metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def precision_recall_f1(tp: Column, fp: Column, n_truth: Column) -> dict[str, Column]:
    """0 where a ratio has no base."""
    p, r = _share(tp, tp + fp), _share(tp, n_truth)
    return {"precision_val": p, "recall_val": r, "f1_val": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def f1_curve(scored: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """scored: keys, score, is_tp; truth: keys, n_truth. A row for each distinct score: cumulative tp, fp, and P, R, F1.

    Scores are grouped before the window, so the window holds distinct scores only.
    """
    by_score = scored.groupBy(*keys, "score").agg(F.sum("is_tp").alias("t"), F.count("*").alias("n"))
    down = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by_score.select(*keys, "score", F.sum("t").over(down).cast("long").alias("tp"), (F.sum("n").over(down) - F.sum("t").over(down)).cast("long").alias("fp"))
    run = run.join(truth, keys) if keys else run.crossJoin(truth)
    return run.withColumns(precision_recall_f1(F.col("tp"), F.col("fp"), F.col("n_truth")))


def best_threshold(scored: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """The score with the largest F1, the higher one of ties; zeros where nothing was scored, found or to be found."""
    curve = f1_curve(scored, truth, keys).where("n_truth > 0 AND f1_val > 0")
    top = Window.partitionBy(*keys).orderBy(F.desc("f1_val"), F.desc("score"))
    best = curve.withColumn("_n", F.row_number().over(top)).where("_n = 1").select(*keys, F.col("score").alias("tau"), "f1_val", "precision_val", "recall_val")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("tau", "f1_val", "precision_val", "recall_val")}
    return (truth.join(best, keys, "left") if keys else truth.crossJoin(best)).withColumns(zero)


def counting_metrics(truth: Column, pred: Column, big: int = 30) -> list[Column]:
    """Aggregates of the errors: MAE, RMSE, bias, R2 (null for constant truth), MAPE over all and over large truths."""
    t, e = truth.cast("double"), (pred - truth).cast("double")
    ape = 100 * F.abs(e) / F.when(t != 0, t)
    large = t >= big
    return [
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        (1 - F.try_divide(F.sum(e * e), F.count(t) * F.var_pop(t))).alias("r2"),
        F.avg(ape).alias("mape_all"), F.avg(F.when(large, ape)).alias("mape_big"), F.count_if(large).alias("n_big"),
    ]


def occupancy_metrics(true_occ: Column, pred_occ: Column) -> list[Column]:
    e = pred_occ - true_occ
    return [(100 * F.avg(F.abs(e))).alias("mae_occ_pp"), (1 - F.try_divide(F.sum(e * e), F.count(true_occ) * F.var_pop(true_occ))).alias("r2_occ")]


def average_precision(scored: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the precision envelope over recall."""
    curve = f1_curve(scored, truth, keys)
    down = Window.partitionBy(*keys).orderBy(F.desc("score"))
    after = down.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    step = F.col("recall_val") - F.coalesce(F.lag("recall_val").over(down), F.lit(0.0))
    return curve.withColumn("_a", step * F.max("precision_val").over(after)).groupBy(*keys).agg(F.sum("_a").alias("ap"))


def best_epoch(log: DataFrame, metric: str) -> DataFrame:
    """The earliest row with the largest metric, and the running best of every epoch as best_so_far."""
    up = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(Window.orderBy(F.desc(metric), "epoch"))
    return log.select("epoch", F.col(metric).alias("metric"), F.max(metric).over(up).alias("best_so_far"), (rank == 1).alias("is_best"))
