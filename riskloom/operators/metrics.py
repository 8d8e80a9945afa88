"""Evaluation metrics from tables of scores and labels. All are grouped sums with one narrow row per distinct score at
most; windows run over distinct scores, in two steps where there may be many."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.lineage import cut


def confusion(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    said = F.col(score) >= threshold
    is_ = F.col(label) == 1
    count = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    c = df.agg(count(said & is_).alias("tp"), count(said & ~is_).alias("fp"), count(~said & is_).alias("fn"), count(~said & ~is_).alias("tn"))
    ratio = lambda a, b: F.try_divide(a, b)
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _prefix(df: DataFrame, order: str, sums: list[str], parts: int = 64) -> DataFrame:
    """``df`` (one row per value of ``order``) with running sums over descending ``order``. Rows are dealt by range, each
    range is summed on its own, and the sums of the ranges before it are added: no task sees all rows."""
    dealt = df.repartitionByRange(parts, F.col(order).desc()).withColumn("__p", F.spark_partition_id())
    dealt = cut(dealt)
    totals = dealt.groupBy("__p").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__p", *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__c_{s}") for s in sums])
    inside = Window.partitionBy("__p").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({f"cum_{s}": F.sum(s).over(inside) for s in sums}).join(carried, "__p")
    return out.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"__c_{s}") for s in sums}).drop("__p", *[f"__c_{s}" for s in sums])


def by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score, high to low: positives, negatives, and both cumulated."""
    is_ = F.col(label) == 1
    steps = df.groupBy(F.col(score).alias("score")).agg(F.sum(is_.cast("long")).alias("pos"), F.sum((~is_).cast("long")).alias("neg"))
    return _prefix(steps, "score", ["pos", "neg"])


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """PR-AUC as average precision: precision at each distinct score, weighted by the recall it adds. Null without a
    positive."""
    s = by_score(df, score, label)
    return s.agg(F.try_divide(F.sum(F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")) * F.col("pos")), F.sum("pos")).alias("pr_auc"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Trapezoids over distinct scores, so ties count one half."""
    s = by_score(df, score, label)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    return s.agg(F.try_divide(area, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def fpr_at_recall(df: DataFrame, score: str, label: str, recall: float) -> DataFrame:
    s = by_score(df, score, label)
    totals = df.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    at = s.crossJoin(F.broadcast(totals)).filter(F.col("cum_pos") >= recall * F.col("p"))  # one row of totals
    return at.agg(F.min(F.col("cum_neg") / F.col("n")).alias("fpr"))


def brier(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    place = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long").alias("bin")
    return df.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def shares(df: DataFrame, place: Column, side: Column, bins: int, floor: float) -> DataFrame:
    """Share of each bin on both sides, at least ``floor``; bins nobody fills are there too."""
    counted = df.groupBy(place.alias("bin")).agg(F.sum(side.cast("long")).alias("a"), F.sum((~side).cast("long")).alias("b"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin"))
    full = every.join(counted, "bin", "left").select("bin", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = Window.partitionBy()
    return full.select("bin", *[F.greatest(F.col(c) / F.sum(c).over(total), F.lit(floor)).alias(c) for c in "ab"])


def psi(df: DataFrame, value: str, is_baseline: Column, cuts: list[float], floor: float = 1e-6) -> DataFrame:
    """Population stability over fixed cuts: sum of (actual - expected) * ln(actual / expected)."""
    place = F.lit(0)
    for c in cuts:
        place = place + (F.col(value) > c).cast("int")
    s = shares(df, place.cast("long"), is_baseline, len(cuts) + 1, floor)
    return s.agg(F.sum((F.col("b") - F.col("a")) * F.ln(F.col("b") / F.col("a"))).alias("psi"))


def ks(df: DataFrame, value: str, is_baseline: Column) -> DataFrame:
    """Largest gap between the two cumulative shares; ties collapse to one step."""
    steps = df.groupBy(F.col(value).alias("v")).agg(F.sum(is_baseline.cast("long")).alias("a"), F.sum((~is_baseline).cast("long")).alias("b"))
    s = _prefix(steps, "v", ["a", "b"])
    totals = F.broadcast(steps.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))  # one row
    return s.crossJoin(totals).agg(F.max(F.abs(F.col("cum_a") / F.col("ta") - F.col("cum_b") / F.col("tb"))).alias("ks"))


def drift(pairs: DataFrame, a: str, b: str) -> Column:
    return F.avg(F.abs(F.col(a) - F.col(b)) / F.greatest(F.abs(F.col(b)), F.lit(1.0)))


def group_median(df: DataFrame, group: str, value: str, name: str, parts: int = 64) -> DataFrame:
    """(group, name): the exact median of each group, the mean of the two middle values of an even number; nulls don't
    count. Distinct values with their counts are dealt by range of group and value, so that a group with a large share
    of all rows spreads over many tasks, and running counts are carried from range to range."""
    steps = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("__g"), F.col(value).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    dealt = cut(steps.repartitionByRange(parts, "__g", "__x").withColumn("__p", F.spark_partition_id()), "median")
    totals = dealt.groupBy("__g", "__p").agg(F.sum("__n").alias("__t"))
    own = Window.partitionBy("__g")
    carried = totals.select("__g", "__p", F.coalesce(F.sum("__t").over(own.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__c"), F.sum("__t").over(own).alias("__all"))
    inside = Window.partitionBy("__g", "__p").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("__upto", F.sum("__n").over(inside)).join(carried.select(F.col("__g").alias("__cg"), F.col("__p").alias("__cp"), "__c", "__all"), F.col("__g").eqNullSafe(F.col("__cg")) & (F.col("__p") == F.col("__cp")))
    upto = F.col("__upto") + F.col("__c")
    at = lambda rank: F.min(F.when(upto > rank, F.col("__x")))
    middle = placed.groupBy("__g").agg(((at(F.floor((F.col("__all") - 1) / 2)) + at(F.floor(F.col("__all") / 2))) / 2).alias(name))
    return middle.withColumnRenamed("__g", group)


def robust_z(df: DataFrame, group: str, value: str) -> DataFrame:
    """``df`` with ``robust_z`` = 0.6745 (x - median) / MAD by group; null where the MAD is 0. Both medians are exact."""
    with_ = lambda rows, side: rows.join(side.withColumnRenamed(group, "__k"), F.col(group).eqNullSafe(F.col("__k")), "left").drop("__k")
    near = with_(df, cut(group_median(df, group, value, "__m"), "median"))
    far = near.withColumn("__d", F.abs(F.col(value) - F.col("__m")))
    out = with_(far, cut(group_median(far, group, "__d", "__mad"), "median"))
    z = 0.6745 * (F.col(value) - F.col("__m")) / F.nullif(F.col("__mad"), F.lit(0.0))
    return out.withColumn("robust_z", z).drop("__m", "__d", "__mad")


def quantile_cuts(df: DataFrame, value: str, bins: int, parts: int = 64) -> list[float]:
    """The values that part a baseline into ``bins`` bins of about equal size: of each rank k n / bins the value there.
    Values and their counts are summed by range; ``bins`` - 1 numbers reach the driver."""
    steps = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = _prefix(steps, "v", ["n"], parts).withColumn("above", F.col("cum_n") - F.col("n"))  # rows of greater values
    total = steps.agg(F.sum("n")).first()[0] or 0
    ranks = F.array(*[F.lit(total - math.ceil(total * k / bins)).cast("long") for k in range(1, bins)]) if total else F.array().cast("array<bigint>")
    hits = placed.withColumn("r", F.explode(ranks)).filter((F.col("above") <= F.col("r")) & (F.col("r") < F.col("cum_n")))
    return sorted({row["v"] for row in hits.select("v").distinct().collect()})


def psi_by_day(df: DataFrame, value: str, at: str, baseline_until: str, bins: int = 10, floor: float = 1e-6) -> DataFrame:
    """(day, n, psi): the daily job. Bins are quantiles of the rows before ``baseline_until``, their shares are the
    baseline's, and each later day is compared with them."""
    early = F.col(at) < F.lit(baseline_until).cast("timestamp")
    cuts = quantile_cuts(df.filter(early), value, bins)
    place = F.lit(0)
    for c in cuts:
        place = place + (F.col(value) > c).cast("int")
    rows = df.filter(F.col(value).isNotNull()).select(F.when(early, F.lit(None)).otherwise(F.to_date(at)).alias("day"), place.alias("bin"))
    counted = rows.groupBy("day", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("bin"))
    base = every.join(counted.filter("day is null").select("bin", "n"), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("a"))
    days = counted.filter("day is not null").groupBy("day").agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))  # as many entries as bins
    sums = base.agg(F.array_sort(F.collect_list(F.struct("bin", "a"))).alias("base"), F.sum("a").alias("base_total"))
    both = days.crossJoin(F.broadcast(sums))  # one row of bins
    share = lambda x, total: F.greatest(x / total, F.lit(floor))

    def term(b):
        expected, actual = share(b["a"], F.col("base_total")), share(F.coalesce(F.try_element_at("by_bin", b["bin"]), F.lit(0)), F.col("total"))
        return (actual - expected) * F.ln(actual / expected)

    return both.select("day", F.col("total").alias("n"), F.aggregate(F.transform("base", term), F.lit(0.0), lambda acc, x: acc + x).alias("psi"))
