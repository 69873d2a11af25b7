"""Range and as-of joins on keys and bins of time, instead of a condition that compares every row of a key.

range_join: an interval lies in two or three bins of its own level, whose width is about its length; a point looks
into one bin of each level that intervals have. So an equi-join finds the candidates, long and short intervals alike.

asof_join: rows of both sides meet in bins of a key's time; what was last before a bin is carried into it by a window
over the key's bins alone. So a key of a third of all rows is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query, read


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, width: float = 60.0) -> DataFrame:
    """The rows of points and of ranges with equal keys and low <= at <= high, numbers all of them.

    width is that of the narrowest bins. Column names but the keys have to differ. Rows with a null key, point or
    end match nothing.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(width)) / width))).cast("int")
    span = lambda lev: F.pow(F.lit(2.0), lev) * width
    bin_of = lambda x, lev: F.floor(x / span(lev)).cast("long")
    r = ranges.where(F.col(low) <= F.col(high)).withColumn("_level", level)
    levels = sorted(x[0] for x in r.select("_level").distinct().collect())  # as many as lengths have powers of two
    r = r.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(low), F.col("_level")), bin_of(F.col(high), F.col("_level")))))
    looked = F.explode(F.array(*[F.struct(F.lit(x).alias("_level"), bin_of(F.col(at), F.lit(x)).alias("_bin")) for x in levels] or [F.struct(F.lit(-1).alias("_level"), F.lit(0).cast("long").alias("_bin"))]))
    p = points.where(F.col(at).isNotNull()).withColumn("_at", looked).withColumns({"_level": F.col("_at._level"), "_bin": F.col("_at._bin")}).drop("_at")
    joined = p.join(r, [*keys, "_level", "_bin"])
    return joined.where((F.col(low) <= F.col(at)) & (F.col(at) <= F.col(high))).drop("_level", "_bin")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, order: list[Column | str] = (), width: float = 86400.0, within: float | None = None) -> DataFrame:
    """left with the columns of the latest row of right of its keys at or before its time (numbers), null if there is none.

    Of right rows of one time the last by order counts. within bounds how old it may be. Column names but the keys
    have to differ. Every row of left stays; null keys and times find nothing.
    """
    value = [c for c in right.columns if c not in keys]
    known = right.dropna(subset=[*keys, right_time])
    latest = F.struct(F.col(right_time), *order, F.struct(*value).alias("_v"))
    bin_of = lambda c: F.floor(F.col(c) / width).cast("long")
    lefts = left.withColumns({"_bin": bin_of(left_time), "_t": F.col(left_time), "_side": F.lit(1), "_r": F.lit(None)})
    rights = known.select(*keys, bin_of(right_time).alias("_bin"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), latest.alias("_r"))
    # What is last in each bin, and what came before it: one row for each bin of a key.
    bins = lefts.select(*keys, "_bin").distinct().unionByName(rights.select(*keys, "_bin").distinct()).distinct()
    ends = rights.groupBy(*keys, "_bin").agg(F.max("_r").alias("_end"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = bins.join(ends, [*keys, "_bin"], "left").withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    both = lefts.drop("_r").unionByName(rights, allowMissingColumns=True)
    # Of rows of one time, right's come first, the last of them last.
    upto = Window.partitionBy(*keys, "_bin").orderBy(F.asc_nulls_first("_t"), "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_r", ignorenulls=True).over(upto)).where("_side = 1")
    found = seen.join(carried, [*keys, "_bin"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    fits = F.col("_t").isNotNull() if within is None else F.col("_last")[right_time] >= F.col("_t") - within
    return found.select(*left.columns, *[F.when(fits, F.col("_last._v")[c]).alias(c) for c in value])


@query("range_join", "SELECT a.event_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND epoch_us(a.ts) BETWEEN epoch_us(b.ts) AND epoch_us(b.ts) + CAST(1000000 * round(60 + b.value * 200) AS BIGINT) AND a.event_id <> b.event_id")
def _range(spark, d):
    """What a user does after each purchase, for a time that follows from the purchase's value."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read(spark, d, "events")
    points = e.select("user_id", "event_id", us.alias("at"))
    ranges = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), us.alias("low"), (us + (F.round(60 + F.col("value") * 200) * 1_000_000).cast("long")).alias("high"))
    return range_join(points, ranges, ["user_id"], "at", "low", "high", 60e6).where("event_id <> purchase_id").select("event_id", "purchase_id")


@query("asof_join", "WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT c.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts")
def _asof(spark, d):
    """Each click with what its user viewed last."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = read(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", us.alias("at"))
    views = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), us.alias("seen"))
    return asof_join(clicks, views, ["user_id"], "at", "seen", ["view_id"], 86400e6).select("event_id", "view_id")
