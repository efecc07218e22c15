"""Upserts, salvage, resumed decisions and last writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_write(df: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The row of the greatest sequence number of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(sequence))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new over old; the same again when repeated."""
    return old.join(new, key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old, key, "left_anti"))


def salvage(old: DataFrame, fresh: DataFrame, key: list[str], frame: list[str], order: str) -> DataFrame:
    """Rows of old whose key fresh lacks, one for each frame, the first in order, and none on a frame of fresh."""
    w = Window.partitionBy(*frame).orderBy(order)
    left = old.join(fresh, key, "left_anti").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return left.join(fresh, frame, "left_anti").select(*old.columns)


def set_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and added, dropped or kept."""
    a, b = old.select(key).distinct().withColumn("_o", F.lit(1)), new.select(key).distinct().withColumn("_n", F.lit(1))
    return (
        a.join(b, key, "full")
        .select(key, F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "dropped").otherwise("kept").alias("change"))
    )
