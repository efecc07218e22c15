"""Ordered analytics: carry forward, monotone filters, best of a group, range joins, sampling and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def carry_forward(df: DataFrame, by: list[str], order: list[str], value: Column, base: Column, name: str) -> DataFrame:
    """The last value that isn't null up to each row, and base before the first."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), base))


def following(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return df.withColumn(name, F.lead(value).over(Window.partitionBy(*by).orderBy(*order)))


def supported(df: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where(F.col("_n") >= least).drop("_n")


def monotone(df: DataFrame, by: list[str], order: list[str], value: str, slack: float = 2) -> DataFrame:
    """Drops what falls more than slack below the greatest value before it; what is dropped never was greatest."""
    before = F.max(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_top", F.coalesce(before, F.lit(-1.0))).where(F.col(value) >= F.col("_top") - slack).drop("_top")


def keep_best(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in an order that ends with a key of the row."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def range_join(left: DataFrame, right: DataFrame, on: list[str], at: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of left with at between low and high of right, both ends included, and equal columns on.

    Intervals go to every bucket of width that they touch, so the join is an equal one; width should be near
    the usual length of an interval.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = right.where(F.col(low) <= F.col(high)).withColumn("_b", F.explode(F.sequence(bucket(low), bucket(high))))
    return left.withColumn("_b", bucket(at)).join(spread, [*on, "_b"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_b")


def spaced(df: DataFrame, by: list[str], order: list[str], limit: int) -> DataFrame:
    """Rows at places int(i n / limit) of each group, all of them if there are no more than limit."""
    w = Window.partitionBy(*by)
    placed = df.withColumn("_p", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    nearest = F.ceil(F.col("_p") * limit / F.col("_n"))
    return (
        placed.where((F.col("_n") <= limit) | ((nearest < limit) & (F.floor(nearest * F.col("_n") / limit) == F.col("_p"))))
        .drop("_p", "_n")
    )


def sample_frames(df: DataFrame, start: str, end: str, interval: int, least: int) -> DataFrame:
    """frame: mid-bin places of max(least, ceil(span / interval)) bins, at most span; one bin: the floor of the middle."""
    span = F.col(end) - F.col(start)
    n = F.least(F.greatest(F.lit(least), F.ceil(span / interval)), span).cast("int")
    bins = F.transform(
        F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
        lambda k: (F.col(start) + F.floor(span / F.greatest(n, F.lit(1)) * (k + 0.5))).cast("long"),
    )
    return df.withColumn("frame", F.explode(F.when(n <= 1, F.array(F.floor((F.col(start) + F.col(end)) / 2).cast("long"))).otherwise(bins)))


def window_around(anchors: Column, desync: int, last: Column) -> Column:
    """Sorted distinct places within desync of any anchor, clamped to 0..last."""
    around = F.transform(anchors, lambda a: F.sequence(F.greatest(a - desync, F.lit(0).cast("long")), F.least(a + desync, last)))
    return F.array_sort(F.array_distinct(F.flatten(around)))


def round_robin(df: DataFrame, by: str, order: list[str], limit: int) -> DataFrame:
    """limit rows, one of each group in turn, groups in order of their keys."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit).orderBy("turn", by).limit(limit)


def spread(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with place (from 1) in an order of which any beginning is spread out: the ends, then the middles, breadth first.

    The depth at which halving an interval meets a row gives its turn: no list of a group is made.
    """
    w = Window.partitionBy(*by)
    placed = df.withColumn("_i", (F.row_number().over(w.orderBy(*order)) - 1).cast("long")).withColumn("_n", F.count("*").over(w))

    def halved(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2)
        there = acc["done"] | (F.col("_i") == mid)
        return F.struct(
            F.when(there | (F.col("_i") < mid), acc["lo"]).otherwise(mid).alias("lo"),
            F.when(there | (F.col("_i") > mid), acc["hi"]).otherwise(mid).alias("hi"),
            F.when(there, acc["depth"]).otherwise(acc["depth"] + 1).alias("depth"),
            there.alias("done"),
        )

    start = F.struct(F.lit(0).cast("long").alias("lo"), (F.col("_n") - 1).alias("hi"), F.lit(0).alias("depth"), F.lit(False).alias("done"))
    depth = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.col("_n") + 1)).cast("int") + 1), start, halved, lambda acc: acc["depth"])
    ends = (F.col("_i") == 0) | (F.col("_i") == F.col("_n") - 1)
    turned = placed.withColumn("_d", F.when(ends, -1).otherwise(depth))
    return turned.withColumn("place", F.row_number().over(w.orderBy("_d", "_i"))).drop("_i", "_n", "_d")


def nearest_of(df: DataFrame, points: DataFrame, value: str, point: str, key: str, most: int = 10_000) -> DataFrame:
    """Each row with the nearest of points, a struct of gap, key and point, the least key on a tie; null without points.

    Up to `most` points travel as one broadcast array. More are held against the distinct values in ranges of the line, with
    the same result.
    """
    listed = points.where(F.col(point).isNotNull()).select(key, point)
    if listed.limit(most + 1).count() > most:
        return _nearest_on_the_line(df, listed, value, point, key)
    listed = listed.agg(F.array_sort(F.collect_list(F.struct(key, point))).alias("_points"))
    gap = lambda p: F.abs(p[point] - F.col(value))
    best = F.array_min(F.transform("_points", lambda p: F.struct(gap(p).alias("gap"), p[key].alias(key), p[point].alias(point))))
    best = F.when(F.col(value).isNotNull(), best)
    return df.join(F.broadcast(listed)).withColumn("nearest", best).drop("_points")


def _nearest_on_the_line(df: DataFrame, points: DataFrame, value: str, point: str, key: str, parts: int = 256) -> DataFrame:
    """nearest_of() by the point below and the point above each distinct value, within ranges and from the ranges beside them."""
    one = points.groupBy(F.col(point).alias("at")).agg(F.min(key).alias("k"))  # of equal points the least key
    bounds = one.agg(F.percentile_approx("at", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    edges = F.array(*[F.lit(b) for b in sorted(set(bounds))])
    part = lambda c: F.size(F.filter(edges, lambda b: b <= c)).alias("part")
    here = F.struct("at", "k").alias("p")
    ends = one.groupBy(part(F.col("at"))).agg(F.min(F.struct("at", "k")).alias("low"), F.max(F.struct("at", "k")).alias("high"))
    every = points.sparkSession.range(len(set(bounds)) + 1).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    before, after = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    beside = every.select("part", F.last("high", True).over(before).alias("below"), F.first("low", True).over(after).alias("above"))  # a row a range
    asked = df.select(F.col(value).alias("v")).where("v is not null").distinct()
    both = asked.select(part(F.col("v")), F.col("v").alias("x"), F.lit(None).cast(one.select(here).schema["p"].dataType).alias("p")).unionByName(one.select(part(F.col("at")), F.col("at").alias("x"), here))
    down, up = Window.partitionBy("part").orderBy("x").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("part").orderBy("x").rangeBetween(0, Window.unboundedFollowing)
    near = both.withColumn("_b", F.last("p", True).over(down)).withColumn("_a", F.first("p", True).over(up)).where("p is null")
    near = near.join(F.broadcast(beside), "part").select("x", F.coalesce("_b", "below").alias("_b"), F.coalesce("_a", "above").alias("_a"))
    gap = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["at"] - F.col("x")).alias("gap"), F.col(c)["k"].alias(key), F.col(c)["at"].alias(point)))
    found = near.select(F.col("x").alias("_x"), F.array_min(F.array_compact(F.array(gap("_b"), gap("_a")))).alias("nearest"))
    return df.drop("nearest").join(found, F.col(value) == F.col("_x"), "left").drop("_x")
