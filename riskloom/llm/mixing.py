"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORDS, aside, discard, fresh, materialize, text_or_empty

NOISE = "[#$%&*!|<>{}~^=]"
LEVELS, BINS = 2, 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: falls with the share of symbols that running prose does not have."""
    noise = F.regexp_count(text, F.lit(NOISE))
    return F.greatest(F.lit(0.1), 1.0 / (1.0 + 20.0 * noise / F.greatest(F.length(text), F.lit(1))))


def _before(rows: DataFrame, order: list[Column], ranges: int, **sums: Column) -> DataFrame:
    """``rows`` with the sum of each column of ``sums`` over the rows before, in a total order. With ``ranges``, rows are
    dealt by range, each range runs on its own, and the sums of the ranges before are added; else in one place."""
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if not ranges:
        return rows.withColumns({name: ahead(Window.orderBy(*order), c) for name, c in sums.items()})
    dealt = materialize(rows.repartitionByRange(ranges, *order).withColumn("__p", F.spark_partition_id()), "mix-ranges")
    totals = dealt.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{name}") for name, c in sums.items()])
    carried = totals.select(F.col("__p").alias("__cp"), *[ahead(Window.orderBy("__p"), F.col(f"__t_{name}")).alias(f"__c_{name}") for name in sums])  # a row a range
    own = dealt.withColumns({name: ahead(Window.partitionBy("__p").orderBy(*order), c) for name, c in sums.items()})
    out = own.join(F.broadcast(carried), F.col("__p") == F.col("__cp"))
    return out.withColumns({name: F.col(name) + F.col(f"__c_{name}") for name in sums}).drop("__p", "__cp", *[f"__c_{name}" for name in sums])


def targets(sizes: DataFrame, weights: tuple[float, ...], cap: float, many: int = 10_000) -> DataFrame:
    """``sizes`` (source, source_size): one row a source. Sources in code point order, null last, take ``weights``
    in turn and share the total of all sizes in proportion, each up to ``cap`` times its size; what lies above is
    shared again among the rest until none is above. That fixed point is a water level: with sources ordered by
    cap / weight, the first k stand at their cap and the others at level x weight, for the one k where the
    level lies under the next cap. The two orders run over one row a source, never over documents, and over ranges of
    sources where there are more than ``many``."""
    ranges = 64 if sizes.limit(many + 1).count() > many else 0
    by_name = [F.col("source").isNull(), F.col("source")]
    rows = _before(sizes, by_name, ranges, turn=F.lit(1))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumn("cap", F.col("source_size") * float(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    totals = F.broadcast(rows.agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights")))  # one row
    rows = _before(rows, [F.col("ratio"), *by_name], ranges, caps=F.col("cap"), weights=F.col("weight")).crossJoin(totals)
    rows = rows.withColumn("level", (F.col("all_sizes") - F.col("caps")) / (F.col("all_weights") - F.col("weights")))
    rows = rows.withColumn("full", F.col("ratio") <= F.col("level"))
    water = F.broadcast(rows.agg(F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).alias("water")))  # one row
    return rows.crossJoin(water).select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("water.level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` with size, source_size, target and taken (words the mix takes, repeats counted) added.

    Each source takes as many whole epochs as its target holds; what is left is filled in one more, fractional
    epoch in the order of exponential keys -ln(u) / w, u hashed from id and text and w the quality weight, so
    better documents come earlier. The document at the boundary gives just the words that fill the target.

    The order within a source is never sorted in one task: the keys fall into 4,096 bins whose word sums are
    prefix-summed, the bin at the boundary is split into 4,096 finer bins, and only rows of the one fine bin at
    the boundary are sorted. Reruns agree, as nothing depends on partitioning. A null text has size 0 and
    takes 0; a null source is a source of its own, last; rows equal in id and text share their place and the words
    left for it, floor by floor. Sources without a word have target 0. Texts are read whole, an empty table gives an
    empty one, and columns of ``docs`` that are named like the four added stay as ``<name>_input``."""
    added = ["size", "source_size", "target", "taken"]
    docs = aside(docs, added)
    key, src = fresh(docs.columns, "__key"), fresh(docs.columns, "__src")
    text = text_or_empty(text_column)
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_column), text), 11) + 1) / float(1 << 53)
    late = 1.0 - F.exp(F.ln(unit) / quality_weight(text))  # the same order as -ln(u) / w, within 0 and 1
    fine = F.least(F.floor(late * (BINS**LEVELS)), F.lit(BINS**LEVELS - 1)).cast("long")
    sized = docs.withColumns({"size": word_count(text), key: F.struct(fine.alias("bin"), late.alias("late"), F.xxhash64(F.col(id_column), text).alias("tie"))})
    rows = sized.select(F.col(source_column).alias("source"), "size", F.col(f"{key}.bin").alias("bin"), F.col(f"{key}.late").alias("late"), F.col(f"{key}.tie").alias("tie"))
    rows = materialize(rows, "mix-sizes")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    plan = targets(sizes, weights, cap).withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    # round() also settles targets that float arithmetic leaves a hair beside a whole number of epochs
    plan = plan.withColumn("left", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = materialize(plan, "mix-targets")

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    edge = plan.select(F.col("source").alias("p_source"), F.col("left"), F.lit(0).cast("long").alias("lo"))
    superseded = []
    for level in range(1, LEVELS + 1):
        width = BINS ** (LEVELS - level)
        edge = materialize(edge, "mix-edge")
        superseded.append(edge)
        part = rows
        if level > 1:
            e = edge.select(F.col("p_source").alias("e_source"), F.col("lo").alias("e_lo"))
            part = _by_source(rows, e, (same("source", "e_source")) & (F.floor(F.col("bin") / (width * BINS)) == F.floor(F.col("e_lo") / (width * BINS))))
        bins = part.groupBy("source", F.floor(F.col("bin") / width).alias("b")).agg(F.sum("size").alias("n"))
        bins = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("b")))
        bins = bins.join(F.broadcast(edge) if edge.count() <= 10_000 else edge, same("source", "p_source"))
        cut = bins.filter(F.col("upto") > F.col("left")).groupBy("p_source").agg(F.min(F.struct("b", (F.col("upto") - F.col("n")).alias("before"), "left")).alias("m"))
        cut = cut.select("p_source", (F.col("m.left") - F.col("m.before")).alias("left"), (F.col("m.b") * width).cast("long").alias("lo"))
        whole = edge.select(F.col("p_source").alias("w_source"), F.lit(BINS**LEVELS).cast("long").alias("all"))
        edge = whole.join(cut, same("w_source", "p_source"), "left").select(
            F.col("w_source").alias("p_source"), F.coalesce("left", F.lit(0)).cast("long").alias("left"), F.coalesce("lo", "all").alias("lo"))
    edge = materialize(edge, "mix-edge")

    border = _by_source(rows, edge, same("source", "p_source") & (F.col("bin") == F.col("lo"))).select("source", "late", "tie", "size", "left")
    order = Window.partitionBy("source").orderBy("late", "tie")
    border = border.groupBy("source", "late", "tie").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.first("left").alias("left"))
    border = border.withColumn("gets", F.greatest(F.lit(0), F.least(F.col("n"), F.col("left") - (F.sum("n").over(order) - F.col("n")))))
    border = border.select(F.col("source").alias("b_source"), F.col("late").alias("b_late"), F.col("tie").alias("b_tie"), F.floor(F.col("gets") / F.col("rows")).cast("long").alias("gets"))
    border = materialize(border, "mix-border")

    whole = plan.select(F.col("source").alias("t_source"), "source_size", "target", "epochs")
    whole = materialize(whole.join(edge.select("p_source", "lo"), same("t_source", "p_source")).drop("p_source"), "mix-plan")
    discard(rows, sizes, plan, edge, *superseded)
    out = sized.withColumn(src, F.col(source_column))
    out = _by_source(out, whole, F.col(src).eqNullSafe(F.col("t_source")))
    on = F.col(src).eqNullSafe(F.col("b_source")) & (F.col(f"{key}.late") == F.col("b_late")) & (F.col(f"{key}.tie") == F.col("b_tie"))
    out = out.join(F.broadcast(border) if border.limit(50_001).count() <= 50_000 else border, on, "left")
    more = F.when(F.col(f"{key}.bin") < F.col("lo"), F.col("size")).otherwise(F.coalesce("gets", F.lit(0)))
    out = out.withColumn("taken", (F.col("epochs") * F.col("size") + more).cast("long"))
    return out.select(*docs.columns, *added)


def _by_source(rows: DataFrame, per_source: DataFrame, on: Column) -> DataFrame:
    """Rows with their source's one row. The table of sources is counted and broadcast up to 10,000 sources;
    beyond, a sort-merge join runs, whose hot sources AQE splits."""
    return rows.join(F.broadcast(per_source) if per_source.limit(10_001).count() <= 10_000 else per_source, on)
