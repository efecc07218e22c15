"""Checks and mappings of record values as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS, CLASSES, KINDS = 64, 13, 6


def left_to_right(found: Column) -> Column:
    """Tokens of detections, an array of structs that begin with the place and end with token, in order of place."""
    return F.transform(F.array_sort(found), lambda d: d["token"])


def labels_ok(labels: Column) -> Column:
    """64 classes of 0 to 12, none null."""
    inside = F.forall(labels, lambda x: F.coalesce((x >= 0) & (x < CLASSES), F.lit(False)))
    return F.coalesce((F.size(labels) == CELLS) & inside, F.lit(False))


def direction_ok(direction: Column, slack: float = 1e-4) -> Column:
    """Two finite numbers of at most 1, of length 1 within slack."""
    fine = F.forall(direction, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= 1), F.lit(False)))
    length = F.sqrt(F.aggregate(direction, F.lit(0.0), lambda a, x: a + x * x))
    return F.coalesce((F.size(direction) == 2) & fine & (F.abs(length - 1) <= slack), F.lit(False))


def classes(spark: SparkSession) -> DataFrame:
    """label, type (0 empty, 1 to 6 kinds) and colour (0 empty, 1 White, 2 Black) of the 13 classes."""
    label = F.col("id")
    kind = F.when(label == 0, 0).otherwise((label - 1) % KINDS + 1)
    colour = F.when(label == 0, 0).when(label <= KINDS, 1).otherwise(2)
    return spark.range(CLASSES).select(label.alias("label"), kind.cast("long").alias("type"), colour.alias("colour"))


def size_spec(spec: Column) -> tuple[Column, Column]:
    """Whether spec is native or a positive whole number, and the number."""
    number = F.when(spec.rlike("^[0-9]+$"), spec.try_cast("long"))
    size = F.when(number > 0, number)
    return F.coalesce((spec == "native") | size.isNotNull(), F.lit(False)), size


def rect_ok(r: Column) -> Column:
    """Positive size, and an origin that isn't negative."""
    return F.coalesce((r["w"] > 0) & (r["h"] > 0) & (r["x"] >= 0) & (r["y"] >= 0), F.lit(False))


def clipped(r: Column, width: int, height: int) -> Column:
    """The part of r inside a frame, of no size where there is none."""
    x, y = F.greatest(r["x"], F.lit(0)), F.greatest(r["y"], F.lit(0))
    w = F.greatest(F.least(r["x"] + r["w"], F.lit(width)) - x, F.lit(0))
    h = F.greatest(F.least(r["y"] + r["h"], F.lit(height)) - y, F.lit(0))
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def thresholds(given: Column, defaults: dict[str, float]) -> dict[str, Column]:
    """Each threshold as the map given names it, or else its default."""
    return {name: F.coalesce(given[name], F.lit(value)) for name, value in defaults.items()}


def round_trip(text: Column, schema: str, names: dict[str, list[str]]) -> Column:
    """JSON read by schema and written again; a column of names keeps those listed; what is null isn't written."""
    read = F.from_json(text, schema)
    kept = reduce(lambda r, n: r.withField(n, F.when(r[n].isin(*names[n]), r[n])), names, read)
    return F.to_json(kept)


def split_fits(splits: Column, wanted: Column) -> Column:
    """One of splits is wanted, or none where there are none."""
    return F.when(F.size(splits) > 0, F.coalesce(F.array_contains(splits, wanted), F.lit(False))).otherwise(wanted.isNull())
