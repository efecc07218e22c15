"""Tables that are replaced whole on stores without a rename: versions beside each other, and pointers that are only added.

target/data/<version> holds a table; target/pointers/<number> is a small file with the name of one, written after it.
The pointer with the greatest number that ends with its mark is the current one: a torn one doesn't count, and
nothing that a reader may be reading is ever moved or written over.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MARK = " whole"


def _there(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _there(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def _said(spark: SparkSession, target: str, number: int) -> str | None:
    """The version that a pointer names; None if it was never written to its end."""
    fs, at = _there(spark, f"{target}/pointers/{number:010d}")
    stream = fs.open(at)
    try:
        text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
    finally:
        stream.close()
    return text.removesuffix(MARK) if text.endswith(MARK) else None


def _numbers(spark: SparkSession, target: str) -> list[int]:
    return sorted((int(n) for n in _names(spark, f"{target}/pointers") if re.fullmatch("[0-9]{10}", n)), reverse=True)


def _pointed(spark: SparkSession, target: str, most: int) -> list[str]:
    """Versions that pointers name, the current one first."""
    found: list[str] = []
    for n in _numbers(spark, target):
        said = _said(spark, target, n)
        if said is not None and said not in found:
            found.append(said)
        if len(found) == most:
            break
    return found


def stage(df: DataFrame, target: str, check: Callable[[DataFrame], None] | None = None) -> str:
    """Writes a new version and checks it as written; readers don't see it before point()."""
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{target}/data/{version}")
    if check:
        check(df.sparkSession.read.parquet(f"{target}/data/{version}"))
    return version


def point(spark: SparkSession, target: str, version: str) -> int:
    """Makes a version the current one; of two writers at once one gets an error, and may try again."""
    number = max(_numbers(spark, target), default=0) + 1
    fs, at = _there(spark, f"{target}/pointers/{number:010d}")
    stream = fs.create(at, False)  # an error if another writer has this number
    try:
        stream.write(bytearray(f"{version}{MARK}".encode()))
    finally:
        stream.close()
    return number


def commit(df: DataFrame, target: str, check: Callable[[DataFrame], None] | None = None) -> str:
    """df as the current version; whatever fails before the pointer is written, the former one stays."""
    version = stage(df, target, check)
    point(df.sparkSession, target, version)
    return version


def current(spark: SparkSession, target: str, back: int = 0) -> DataFrame | None:
    """The current version, or the one so many before it; None if there is none."""
    found = _pointed(spark, target, back + 1)
    return spark.read.parquet(f"{target}/data/{found[back]}") if len(found) > back else None


def vacuum(spark: SparkSession, target: str, keep: int = 2) -> list[str]:
    """Deletes all but the last versions that were current, and versions that no pointer names; the names of those deleted.

    It is for times without a writer: a version staged but not yet pointed at goes too.
    """
    if keep < 1:
        raise ValueError("the current version stays")
    kept = {*_pointed(spark, target, keep)}
    gone = sorted(v for v in _names(spark, f"{target}/data") if v not in kept)
    for n in _numbers(spark, target):  # pointers first, so none names what is gone
        if _said(spark, target, n) not in kept:
            fs, at = _there(spark, f"{target}/pointers/{n:010d}")
            fs.delete(at, False)
    for v in gone:
        fs, at = _there(spark, f"{target}/data/{v}")
        fs.delete(at, True)
    return gone
