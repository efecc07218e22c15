"""Checks of tables: duplicates, straddling groups, leakage, inventories, checksums, strict one-to-one joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def straddling(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups with members in more than one split."""
    return df.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def completeness(expected: DataFrame, found: DataFrame, key: str, by: str) -> DataFrame:
    """Per value of by: expected, available and missing keys, and whether the set is partial."""
    seen = found.select(key).distinct().withColumn("_seen", F.lit(1))
    return (
        expected.join(seen, key, "left")
        .groupBy(by)
        .agg(F.count("*").alias("expected"), F.count("_seen").alias("available"), F.count_if(F.col("_seen").isNull()).alias("missing"))
        .withColumn("partial", F.col("missing") > 0)
    )


def difference(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Key and status of what isn't the same in both: missing (left only), unexpected (right only), changed."""
    a, b = left.select(key, F.col(value).alias("_a"), F.lit(True).alias("_l")), right.select(key, F.col(value).alias("_b"), F.lit(True).alias("_r"))
    status = (
        F.when(F.col("_r").isNull(), "missing")
        .when(F.col("_l").isNull(), "unexpected")
        .when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    )
    return a.join(b, key, "full").select(key, status.alias("status")).where("status is not null")


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each row of df and rule that isn't kept; a rule that gives null isn't kept."""
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return df.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df as it is; a row that breaks a rule ends the job, naming the rule."""
    out = df
    for name, rule in rules.items():
        out = out.where(F.when(F.coalesce(rule, F.lit(False)), True).otherwise(F.raise_error(F.lit(f"rule broken: {name}")).cast("boolean")))
    return out


def audit(spark, checks: dict[str, DataFrame]) -> DataFrame:
    """name, failures and passed of each check, a frame of what is wrong."""
    parts = [df.agg(F.count("*").alias("failures")).select(F.lit(name).alias("name"), "failures", (F.col("failures") == 0).alias("passed")) for name, df in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overlaps(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """one, other and shared: how many keys each pair of sets shares; disjoint ones give no row."""
    parts = [df.select(key).distinct().select(key, F.lit(name).alias("part")) for name, df in sets.items()]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    held = all_.groupBy(key).agg(F.array_sort(F.collect_set("part")).alias("in")).where(F.size("in") > 1)
    pairs = F.flatten(
        F.transform("in", lambda a: F.transform(F.filter("in", lambda b: b > a), lambda b: F.struct(a.alias("one"), b.alias("other")))),
    )
    return held.select(F.inline(pairs)).groupBy("one", "other").agg(F.count("*").alias("shared"))


def issues(found: dict[str, DataFrame]) -> DataFrame:
    """issue and what, as text: every row of every frame of one column under its name."""
    parts = [df.select(F.lit(name).alias("issue"), F.col(df.columns[0]).cast("string").alias("what")) for name, df in found.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def manifest_counts(records: DataFrame, video: str, group: str) -> DataFrame:
    """videos, groups, pairs of both, and groups of more than one video."""
    pairs = records.select(video, group).distinct()
    per = pairs.groupBy(group).agg(F.count("*").alias("n"))
    counts = per.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count_if(F.col("n") > 1).alias("cross_video"))
    return pairs.agg(F.count_distinct(video).alias("videos")).join(F.broadcast(counts))


def nonempty(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no rows: a rate of nothing is none. One row is looked at."""
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def sample_identity(sample_id: Column, image: Column) -> Column:
    """The id of a record, or else the stem of its image, or null without both."""
    stem = F.regexp_extract(image, r"([^/]+?)(\.[^./]*)?$", 1)
    return F.coalesce(F.nullif(sample_id, F.lit("")), F.nullif(stem, F.lit("")))


def manifest_issues(records: DataFrame, expected: dict[str, int], images: DataFrame, partial: bool = False) -> DataFrame:
    """issue and what of everything that is wrong with a manifest, none if it is whole.

    records has index, sample_id, image, split and game_id, each but the index null or empty at worst; expected the rows of each
    split; images the column image of the files that there are. An image must be images/<identity>.jpg; a split
    must be among expected, with as many rows; identities and images occur once, a game in one split. Every record
    that breaks a rule has a row; no list is made of any group.
    """
    r = records.select("index", sample_identity(F.col("sample_id"), F.col("image")).alias("id"), F.nullif("image", F.lit("")).alias("image"), "split", F.nullif("game_id", F.lit("")).alias("game_id"))
    valid = F.coalesce(F.col("split").isin(*expected), F.lit(False))
    canonical = F.concat(F.lit("images/"), F.col("id"), F.lit(".jpg"))
    number = F.col("index").cast("string")
    marks = {
        "no sample identity": F.when(F.col("id").isNull(), number),
        "no image path": F.when(F.col("image").isNull(), number),
        "other image path": F.when(F.col("image").isNotNull() & ~F.col("image").eqNullSafe(canonical), F.concat_ws(" ", number, "image")),
        "invalid split": F.when(~valid, F.concat_ws(" ", number, "split")),
        "no game": F.when(F.col("game_id").isNull(), number),
    }
    broken = F.array_compact(F.array(*[F.when(what.isNotNull(), F.struct(F.lit(name).alias("issue"), what.alias("what"))) for name, what in marks.items()]))
    of_rows = r.select(F.inline(broken))
    named = lambda df, name, *what: df.select(F.lit(name).alias("issue"), F.concat_ws(" ", *what).alias("what"))
    sizes = records.sparkSession.createDataFrame([*expected.items()], "split string, want long")
    counts = r.groupBy("split").agg(F.count("*").alias("n")).join(sizes, "split", "full").where(F.coalesce("n", F.lit(0)) != F.coalesce("want", F.lit(0)))
    crops = r.where(F.col("image") == F.concat(F.lit("images/"), F.regexp_extract("image", r"([^/]+?)(\.[^./]*)?$", 1), F.lit(".jpg")))
    missing = crops.join(images.select("image").distinct(), "image", "left_anti")
    found = [
        of_rows,
        named(duplicates(r.where("id is not null"), "id"), "repeated id", "id"),
        named(duplicates(r.where("image is not null"), "image"), "repeated image", "image"),
        named(straddling(r.where(valid & F.col("game_id").isNotNull()), "game_id", "split"), "game in several splits", "game_id"),
        named(counts, "count of split", F.coalesce("split", F.lit("none")), F.coalesce("n", F.lit(0)).cast("string")),
        named(missing, "missing image", "image"),
    ]
    if partial:
        found.append(records.sparkSession.createDataFrame([("partial", "the manifest says so itself")], "issue string, what string"))
    return reduce(DataFrame.unionByName, found)
