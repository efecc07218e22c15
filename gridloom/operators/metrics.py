"""Scores of predictions: tolerance curves, bands, error decomposition, cost roll-ups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.text import band

TOLERANCES = (0, 1, 2, 3, 5, 10)


def within(wrong: Column) -> list[Column]:
    """Share of rows with at most t wrong, for each tolerance."""
    return [F.round(F.avg((wrong <= t).cast("double")), 6).alias(f"within_{t}") for t in TOLERANCES]


def with_overall(df: DataFrame, key: str, *measures: Column, overall: str = "overall") -> DataFrame:
    """Measures of each key and of all rows together, by one grouping-sets aggregation."""
    return (
        df.groupingSets([[key], []], key)
        .agg(*measures, F.grouping(key).alias("_all"))
        .withColumn(key, F.when(F.col("_all") == 1, overall).otherwise(F.col(key)))
        .drop("_all")
    )


def board_measures() -> list[Column]:
    """Exact rate, rates of cells, occupancy and pieces (NaN without an occupied cell), mean wrong cells."""
    n = F.count("*")
    pieces = F.when(F.sum("occupied") > 0, F.sum("piece_correct") / F.sum("occupied")).otherwise(F.lit(float("nan")))
    return [
        n.alias("n"),
        F.round(F.avg((F.col("correct") == 64).cast("double")), 6).alias("exact_rate"),
        F.round(F.sum("correct") / (n * 64), 6).alias("cell_rate"),
        F.round(F.sum("occupancy_correct") / (n * 64), 6).alias("occupancy_rate"),
        F.round(pieces, 6).alias("piece_rate"),
        F.round(F.avg(64 - F.col("correct")), 6).alias("mean_wrong"),
        *within(64 - F.col("correct")),
    ]


def error_decomposition(boards: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """Per cell: boards, occupied, occupancy_wrong and type_wrong counts. Sums of parts give the whole."""
    cells = (
        boards.select(F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("t"))).alias("cell", "v"))
        .select("cell", F.col("v.p").alias("p"), F.col("v.t").alias("t"))
    )
    both = (F.col("p") > 0) & (F.col("t") > 0)
    return cells.groupBy("cell").agg(
        F.count("*").alias("boards"),
        F.sum((F.col("t") > 0).cast("long")).alias("occupied"),
        F.sum(((F.col("p") > 0) != (F.col("t") > 0)).cast("long")).alias("occupancy_wrong"),
        F.sum((both & (F.col("p") != F.col("t"))).cast("long")).alias("type_wrong"),
    )


class Features:
    """Named numbers of a row, each an expression, by which metrics are told apart in bands."""

    def __init__(self):
        self._made: dict[str, Callable[[], Column]] = {}

    def add(self, name: str) -> Callable:
        def put(function: Callable[[], Column]) -> Callable[[], Column]:
            if name in self._made:
                raise ValueError(f"{name} is there already")
            self._made[name] = function
            return function

        return put

    def names(self) -> list[str]:
        return sorted(self._made)

    def of(self, name: str) -> Column:
        if name not in self._made:
            raise KeyError(f"unknown feature {name}; there are {', '.join(self.names())}")
        return self._made[name]()


def band_names(n: int) -> list[str]:
    """Two or three bands have words, more are numbered, from the lowest."""
    return {2: ["low", "high"], 3: ["low", "medium", "high"]}.get(n) or [f"band{k}" for k in range(n)]


def middle_cuts(df: DataFrame, features: Features, names: list[str]) -> dict[str, list[float]]:
    """The default cut of each feature: its value at place floor(n / 2) of all, from 0; one value a feature reaches the driver."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), features.of(n).cast("double").alias("value")) for n in names]))
    values = df.select(each.alias("f")).select("f.feature", "f.value").where("value is not null")
    return {r["feature"]: [r["value"]] for r in nearest_rank(values, "feature", "value", [0.5]).collect()}


def by_bands(df: DataFrame, features: Features, cuts: dict[str, list[float]], measures: list[Column], overall: str = "overall") -> DataFrame:
    """feature, band, place (of the band, from the lowest) and measures of each band of each feature, and of all rows once.

    One scan and one aggregation by grouping sets serve all features. A value equal to a cut is in the band above it; a
    null value is in none (band null), so that a feature's bands add up to all rows. Bands without rows have none here.
    """
    place = {n: F.when(features.of(n).isNotNull(), band(features.of(n).cast("double"), sorted(c))) for n, c in cuts.items()}
    keyed = df.select("*", *[p.alias(f"_band_{n}") for n, p in place.items()])
    keys = [f"_band_{n}" for n in cuts]
    told = keyed.groupingSets([*[[k] for k in keys], []], *keys).agg(*measures, *[F.grouping(k).alias(f"_free{k}") for k in keys])
    feature, at, name = F.lit(overall), F.lit(None).cast("int"), F.lit(None).cast("string")
    for n, k in zip(cuts, keys, strict=True):
        own = F.col(f"_free{k}") == 0
        feature, at = F.when(own, n).otherwise(feature), F.when(own, F.col(k)).otherwise(at)
        name = F.when(own, F.get(F.array(*map(F.lit, band_names(len(cuts[n]) + 1))), F.col(k))).otherwise(name)
    out = [c for c in told.columns if not c.startswith("_band_") and not c.startswith("_free")]
    return told.select(feature.alias("feature"), name.alias("band"), at.cast("int").alias("place"), *out)


def nearest_rank(df: DataFrame, key: str, value: str, fractions: list[float]) -> DataFrame:
    """Per key, for each fraction f the value at place min(n - 1, floor(f n)) of the sorted values.

    Equal values are counted once and their places read off a running count, so no key's rows are sorted
    one by one in a task.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("_times"))
    w = Window.partitionBy(key).orderBy(value)
    ranked = counts.withColumn("_upto", F.sum("_times").over(w)).withColumn("_n", F.sum("_times").over(Window.partitionBy(key)))
    f = F.explode(F.array(*[F.lit(float(x)) for x in fractions]))
    return (
        ranked.withColumn("fraction", f)
        .where(F.col("_upto") > F.least(F.col("_n") - 1, F.floor(F.col("fraction") * F.col("_n"))))
        .groupBy(key, "fraction")
        .agg(F.min(value).alias("value"))
    )


def medians(df: DataFrame, by: str, value: str, most: int = 1 << 19) -> DataFrame:
    """by and median, the exact middle of its values, or the mean of the two; null values don't count."""
    return medians_of(df, by, {"median": value}, most)


def medians_of(df: DataFrame, by: str, values: dict[str, str], most: int = 1 << 19) -> DataFrame:
    """by and, under each name, the median of a column of numbers: null for a key that has null values only.

    Rows are dealt by key to one task for each `most` of them, so that a task's share doesn't grow with the table, and their
    values are put in order there. Of a key of more than `most` rows only the values about its middle are (`_about_middle`).
    """
    columns = [f"v{i}" for i in range(len(values))]
    rows = df.select(F.col(by).alias("key"), *[F.col(v).cast("double").alias(c) for c, v in zip(columns, values.values(), strict=True)])
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), F.array(*map(F.count, columns)).alias("counts"))
    total, largest = sizes.agg(F.sum("rows"), F.max("rows")).first()
    tasks = max(-(-(total or 0) // most), df.sparkSession.sparkContext.defaultParallelism)
    if (largest or 0) <= most:
        found = _middles(_stacked(rows.repartition(tasks, "key"), columns), list(values))
    else:
        large = F.broadcast(sizes.where(F.col("rows") > most).withColumnRenamed("key", "of"))  # one row for `most` rows at most
        same = F.col("key").eqNullSafe(F.col("of"))
        few = _stacked(rows.join(large, same, "left_anti").repartition(tasks, "key"), columns)
        many = _about_middle(_stacked(rows.join(large, same), columns, "counts"), max(1, most // 64), largest)
        found = _middles(few, list(values)).unionByName(_middles(many.repartition(tasks, "key"), list(values)))
    return found.withColumnRenamed("key", by)


def _stacked(rows: DataFrame, columns: list[str], *kept: str) -> DataFrame:
    """key, c, v: a row for each of the columns, numbered from 0."""
    pairs = [x for i, c in enumerate(columns) for x in (F.lit(i), F.col(c))]
    return rows.select("key", *kept, F.stack(F.lit(len(columns)), *pairs).alias("c", "v"))


def _middles(rows: DataFrame, names: list[str]) -> DataFrame:
    """key and the median of each number c under its name, of key, c, v; or of v that stand for `times`, `before` others, of n."""
    w = Window.partitionBy("key", "c").orderBy(F.asc_nulls_last("v"))
    upto, whole = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if "times" in rows.columns:
        ends = rows.withColumn("end", F.col("before") + F.sum("times").over(upto))
    else:
        ends = rows.select("*", F.count("v").over(upto).alias("end"), F.count("v").over(whole).alias("n")).withColumn("times", F.col("v").isNotNull().cast("long"))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)

    def held(i: int, at: Column) -> Column:
        return F.max(F.when((F.col("c") == i) & (F.col("end") > at) & (F.col("end") - F.col("times") <= at), F.col("v")))

    return ends.groupBy("key").agg(*[((held(i, low) + held(i, high)) / 2).alias(name) for i, name in enumerate(names)])


def _about_middle(rows: DataFrame, rate: int, largest: int) -> DataFrame:
    """key, c, v, times (rows of v), before (values less than all here) and n of each key and c of rows: the values about the middle.

    One of `rate` values, told by hash and so the same whenever it is asked, ends a part. Parts are counted, and only the
    values of the part, or two, that the middle falls in are kept, equal ones as one row: no more of a larger key.
    """
    of = ["key", "c"]
    sample = rows.where((F.pmod(F.xxhash64("v"), F.lit(rate)) == 0) & F.col("v").isNotNull())
    halvings = (2 * (largest // rate) + 32).bit_length()
    ends = sample.groupBy(*of).agg(F.slice(F.array_sort(F.collect_set("v")), 1, (1 << halvings) - 1).alias("ends"))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = F.broadcast(right.withColumnsRenamed({k: f"{k}_" for k in of}))
        return left.join(right, F.col("key").eqNullSafe(F.col("key_")) & (F.col("c") == F.col("c_")), how).drop("key_", "c_")

    rows = rows.select(*of, "v", F.get("counts", F.col("c")).alias("n"))
    dealt = joined(rows, ends, "left").withColumn("part", F.lit(0))
    for i in reversed(range(halvings)):  # the number of ends below v
        dealt = dealt.withColumn("part", F.when(F.get("ends", F.col("part") + ((1 << i) - 1)) < F.col("v"), F.col("part") + (1 << i)).otherwise(F.col("part")))
    counts = dealt.groupBy(*of, "part").agg(F.count("v").alias("k"), F.first("n").alias("n"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.partitionBy(*of).orderBy("part")))
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    hit = (
        upto.where((F.col("upto") > low) & (F.col("upto") - F.col("k") <= high))
        .groupBy(*of)
        .agg(F.min("part").alias("first"), F.max("part").alias("last"), F.min(F.col("upto") - F.col("k")).alias("before"))
    )
    reach = joined(hit, ends, "left").select(*of, "before", F.get("ends", F.col("first") - 1).alias("above"), F.get("ends", "last").alias("end"))
    inside = (F.col("above").isNull() | (F.col("v") > F.col("above"))) & (F.col("end").isNull() | F.col("v").isNull() | (F.col("v") <= F.col("end")))
    return (
        joined(rows, reach, "inner")
        .where(inside)
        .groupBy(*of, "v")
        .agg(F.count("v").alias("times"), F.first("before").alias("before"), F.first("n").alias("n"))
    )
