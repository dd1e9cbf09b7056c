"""Evaluation: classification metrics in two conventions, judge counts, length summaries, running figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.order import running_sums


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ratios(counts: DataFrame) -> DataFrame:
    """counts: label, tp, fp, fn; ratios without a denominator are 0."""
    out = counts.withColumns({"precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _classes(df: DataFrame, classes: list) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(c,) for c in classes], "label " + ("string" if isinstance(classes[0], str) else "int"))


def prf_all_predictions(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """Per class tp, fp, fn, precision, recall, f1 where a prediction outside the classes is a miss of the true class."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n")).where(F.col("t").isin(*classes))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("t").alias("label"), F.lit(True).alias("is_truth")), F.struct(F.col("p").alias("label"), F.lit(False).alias("is_truth")))).alias("x"), "t", "p", "n").select("x.*", (F.col("t").eqNullSafe(F.col("p"))).alias("hit"), "n")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = sides.groupBy("label").agg(total(F.col("is_truth") & F.col("hit")).alias("tp"), total(~F.col("is_truth") & ~F.col("hit")).alias("fp"), total(F.col("is_truth") & ~F.col("hit")).alias("fn"))
    return ratios(F.broadcast(_classes(df, classes)).join(counts, "label", "left").fillna(0))


def confusion(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """(gt, pred, n) for all pairs of classes, 0 where none; rows with either outside the classes are left out."""
    c = _classes(df, classes)
    grid = c.select(F.col("label").alias("gt")).join(F.broadcast(c.select(F.col("label").alias("pred"))))
    counts = df.where(F.col(truth).isin(*classes) & F.col(pred).isin(*classes)).groupBy(F.col(truth).alias("gt"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["gt", "pred"], "left").fillna(0, ["n"])


def prf_matrix(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """Per class figures out of the confusion matrix: predictions outside the classes don't hurt recall."""
    m = confusion(df, truth, pred, classes)
    rows = m.select(F.explode(F.array(F.struct(F.col("gt").alias("label"), F.lit(True).alias("is_gt")), F.struct(F.col("pred").alias("label"), F.lit(False).alias("is_gt")))).alias("x"), (F.col("gt") == F.col("pred")).alias("hit"), "n").select("x.*", "hit", "n")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return ratios(rows.groupBy("label").agg(total(F.col("is_gt") & F.col("hit")).alias("tp"), total(~F.col("is_gt") & ~F.col("hit")).alias("fp"), total(F.col("is_gt") & ~F.col("hit")).alias("fn")))


def summary(per_class: DataFrame, df: DataFrame, truth: str, pred: str, classes: list | None = None) -> DataFrame:
    """One row: accuracy (over all rows, or over those whose truth is in classes) and macro means."""
    rows = df if classes is None else df.where(F.col(truth).isin(*classes))
    acc = rows.agg(_ratio(F.count_if(F.col(truth) == F.col(pred)), F.count(F.lit(1))).alias("accuracy"))
    macro = per_class.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))
    return acc.join(F.broadcast(macro))


def judge_metrics(df: DataFrame, label: Column, error: Column) -> DataFrame:
    """One row of counts; a failed call has no label either, so it also counts as a parse failure."""
    valid = F.count_if(label.isNotNull())
    return df.agg(
        F.count(F.lit(1)).alias("num_samples"), valid.alias("num_valid_labels"), F.count_if(label == 1).alias("num_label_1"),
        F.count_if(label.isNull()).alias("num_parse_fail"), F.count_if(F.coalesce(error, F.lit("")) != "").alias("num_api_fail"),
        _ratio(F.count_if(label == 1), valid).alias("accuracy_consistency"),
    )


def running_rate(df: DataFrame, flag: Column, position: str, by: str) -> DataFrame:
    """df with the share of flagged rows up to each row, inside each group of `by` (a run or shard, so no global sort)."""
    w = Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"seen": F.count(F.lit(1)).over(w), "rate": F.avg(flag.cast("double")).over(w)})


def running_every(df: DataFrame, flag: Column, position: str, every: int, warn: float = 0.3) -> DataFrame:
    """(upto, seen, rate, warned): the share of flagged rows after every so many positions (from 1), and whether it is above warn.

    Rows are summed by stretches first; these sums, a row for each stretch, are run through by partitions of their range.
    """
    stretch = F.floor((F.col(position) - 1) / every).cast("long")
    sums = df.groupBy(stretch.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("k"), F.max(position).alias("upto"))
    run = running_sums(sums, ["s"], {"seen": "n", "hits": "k"})
    out = run.select("upto", "seen", _ratio(F.col("hits"), F.col("seen")).alias("rate"))
    return out.withColumn("warned", F.col("rate") > warn)


PERCENTILES = (0.5, 0.9, 0.95, 0.99)


def length_summary(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """count, min, nearest-rank percentiles, max and mean.

    Lengths are folded to (value, count) first, and percentiles are read off the running count, so nothing grows with the rows.
    """
    keys = [by] if by else []
    folded = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    run = folded.withColumns({"below": F.sum("k").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(w)})
    at = lambda p: F.min(F.when(F.col("below") >= F.ceil(F.col("n") * F.lit(p)), F.col("v"))).alias(f"p{int(p * 100)}")
    return run.groupBy(*keys).agg(F.sum("k").alias("count"), F.min("v").alias("min"), *[at(p) for p in PERCENTILES], F.max("v").alias("max"), F.round(F.sum(F.col("v") * F.col("k")) / F.sum("k"), 2).alias("mean"))


BINS = (128, 256, 512, 1024, 2048, 4096)


def histogram(df: DataFrame, value: str, bins: tuple[int, ...] = BINS) -> DataFrame:
    """(bin, n) with the first bin that holds each value, the overflow, and zeros."""
    spark = df.sparkSession
    names = [f"<= {b}" for b in bins] + [f"> {bins[-1]}"]
    case = F
    for b, name in zip(bins, names, strict=False):
        case = case.when(F.col(value) <= b, F.lit(name))
    counts = df.where(F.col(value).isNotNull()).groupBy(case.otherwise(F.lit(names[-1])).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return spark.createDataFrame([(x,) for x in names], "bin string").join(counts, "bin", "left").fillna(0, ["n"])
