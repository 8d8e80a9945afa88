"""Per-key time order that holds up when one key has a large share of all rows.

A window over a whole key puts the key's history in one task. Here a key's rows are dealt by key *and* stretch of time,
and what crosses a border is carried separately: as copies of the rows just before it (trailing frames), or as one
summary row per key and stretch (previous row, running sum, last match).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def stretch(at: str, seconds: int) -> Column:
    return F.floor(F.unix_micros(F.col(at)) / (seconds * 1_000_000))


def trailing(df: DataFrame, key: str, at: str, frames: dict[str, tuple[int, Column]], seconds: int | None = None) -> DataFrame:
    """``df`` with a column per frame: name -> (seconds, aggregate). A row sees the rows of its key from ``seconds``
    before it to itself, both ends included, and rows of the same instant too."""
    seconds = max([seconds or DAY, *(s for s, _ in frames.values())])
    own, late = stretch(at, seconds), F.unix_micros(F.col(at)) % (seconds * 1_000_000) >= (seconds - max(s for s, _ in frames.values())) * 1_000_000
    copies = F.when(late, F.array(F.struct(own.alias("s"), F.lit(True).alias("own")), F.struct((own + 1).alias("s"), F.lit(False).alias("own"))))
    dealt = df.withColumn("__c", F.explode(copies.otherwise(F.array(F.struct(own.alias("s"), F.lit(True).alias("own"))))))
    order = Window.partitionBy(key, "__c.s").orderBy(F.unix_micros(F.col(at)))
    out = dealt.select("*", *[agg.over(order.rangeBetween(-s * 1_000_000, 0)).alias(name) for name, (s, agg) in frames.items()])
    return out.filter("__c.own").drop("__c")


def _carried(df: DataFrame, key: str, summary: Column, combine) -> DataFrame:
    """One row (key, stretch, carry): ``combine`` over the summaries of the key's earlier stretches."""
    parts = df.groupBy(key, "__s").agg(summary.alias("__p"))
    before = Window.partitionBy(key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col(key).alias("__k"), F.col("__s").alias("__ks"), combine(F.col("__p")).over(before).alias("__carry"))


def _with_carry(df: DataFrame, key: str, carried: DataFrame) -> DataFrame:
    return df.join(carried, F.col(key).eqNullSafe(F.col("__k")) & F.col("__s").eqNullSafe(F.col("__ks")), "left").drop("__k", "__ks")


def last_before(df: DataFrame, key: str, order: list[str], at: str, value: Column, name: str, seconds: int = 7 * DAY) -> DataFrame:
    """``df`` with ``name``: the value of the last earlier row of the key, in ``order``, that has one (nulls are
    passed over). ``order`` starts with ``at`` and must be total, so that ties can't change the answer."""
    df = df.withColumn("__s", stretch(at, seconds)).withColumn("__v", value)
    latest = F.max_by(F.col("__v"), F.when(F.col("__v").isNotNull(), F.struct(*order)))
    carried = _carried(df, key, latest, lambda p: F.last(p, ignorenulls=True))
    inside = Window.partitionBy(key, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = df.withColumn("__near", F.last("__v", ignorenulls=True).over(inside))
    return _with_carry(near, key, carried).withColumn(name, F.coalesce("__near", "__carry")).drop("__s", "__v", "__near", "__carry")


def running_sum(df: DataFrame, key: str, order: list[str], at: str, value: Column, name: str, seconds: int = 7 * DAY) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the key's rows up to this one, in total order."""
    df = df.withColumn("__s", stretch(at, seconds)).withColumn("__v", value)
    carried = _carried(df, key, F.sum("__v"), F.sum)
    inside = Window.partitionBy(key, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    near = df.withColumn("__near", F.sum("__v").over(inside))
    return _with_carry(near, key, carried).withColumn(name, F.col("__near") + F.coalesce("__carry", F.lit(0))).drop("__s", "__v", "__near", "__carry")


def greatest_before(df: DataFrame, at: str, value: Column, name: str, width: int = 1024) -> DataFrame:
    """``df`` with ``name``: the greatest ``value`` of all rows whose integer ``at`` is smaller. One summary row per
    ``at``, in ranges of ``width``: each range runs on its own, and only the ranges' tops, a thousandth of the rows, are
    ordered in one place."""
    tops = df.groupBy(F.col(at).alias("__at")).agg(F.max(value).alias("__top")).withColumn("__range", F.floor(F.col("__at") / width))
    before = lambda w: F.max("__top").over(w.rowsBetween(Window.unboundedPreceding, -1))
    ranges = tops.groupBy("__range").agg(F.max("__top").alias("__top")).select("__range", before(Window.orderBy("__range")).alias("__carry"))
    inside = tops.withColumn("__inside", before(Window.partitionBy("__range").orderBy("__at")))
    marks = inside.join(ranges, "__range").select("__at", F.greatest("__inside", "__carry").alias(name))
    return df.join(marks, F.col(at) == F.col("__at"), "left").drop("__at")


def sessions(df: DataFrame, key: str, order: list[str], at: str, gap: int) -> DataFrame:
    """``df`` with ``session``, from 1: a new one starts where more than ``gap`` seconds passed since the key's
    previous row."""
    df = last_before(df, key, order, at, F.unix_micros(F.col(at)), "__prev")
    starts = F.when(F.col("__prev").isNull() | (F.unix_micros(F.col(at)) - F.col("__prev") > gap * 1_000_000), 1).otherwise(0)
    return running_sum(df, key, order, at, starts, "session").drop("__prev")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, left_id: str, right_id: str, take: list[str], seconds: int = 7 * DAY) -> DataFrame:
    """Each row of ``left`` with the columns ``take`` of the key's last row of ``right`` strictly before it, null where
    there is none. Both sides have ``key`` and ``at``; at equal instants the left row comes first, so nothing from its
    own instant leaks in. One union and one pass in time order; no pairs are formed."""
    lhs = left.withColumns({"__side": F.lit(0), "__id": F.col(left_id).cast("string"), "__r": F.lit(None).cast(right.select(F.struct(*take)).schema[0].dataType)})
    kept = [c for c in left.columns if c not in (key, at)]
    r = right.select(key, at, F.lit(1).alias("__side"), F.col(right_id).cast("string").alias("__id"), F.struct(*take).alias("__r"))
    both = lhs.select(key, at, "__side", "__id", "__r", F.struct(*kept).alias("__l")).unionByName(r.withColumn("__l", F.lit(None).cast(lhs.select(F.struct(*kept)).schema[0].dataType)))
    out = last_before(both, key, [at, "__side", "__id"], at, F.col("__r"), "__found", seconds).filter("__side = 0")
    return out.select(key, at, *[F.col(f"__l.{c}").alias(c) for c in kept], *[F.col(f"__found.{c}").alias(c) for c in take])


def near_in_time(df: DataFrame, entity: str, actor: str, order: list[str], at: str, seconds: int) -> DataFrame:
    """Rows whose entity another actor used within ``seconds`` before: (row, other, gap). Only the latest other actor
    is named, so a busy entity costs a row a use, not a row a pair; rows linked in this way have the same connected
    components as all pairs have, as the uses between two others are themselves linked."""
    base = df.withColumn("__use", F.struct(F.col(actor).alias("actor"), F.unix_micros(F.col(at)).alias("us")))
    one = last_before(base, entity, order, at, F.col("__use"), "__one")
    # where the previous use is by the same actor, its own previous other actor is the one to take
    changed = F.when(F.col("__one").isNotNull() & (F.col("__one.actor") != F.col(actor)), F.col("__one"))
    own = one.withColumn("__changed", changed)
    again = last_before(own, entity, order, at, F.col("__changed"), "__two")
    other = F.coalesce(F.col("__changed"), F.col("__two"))
    out = again.withColumn("other", other["actor"]).withColumn("gap_us", F.unix_micros(F.col(at)) - other["us"])
    return out.filter((F.col("gap_us") <= seconds * 1_000_000) & (F.col("other") != F.col(actor))).drop("__use", "__one", "__changed", "__two")


def dedup(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; an aggregate with map-side combining, so copies of one key meet as
    one row a task. ``order`` and then all columns decide, so the result is the same in every run."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *rest)).alias("__first")
    return df.groupBy(*keys).agg(first).select(*[F.col(k) if k in keys else F.col(f"__first.{k}").alias(k) for k in df.columns])
