"""Writers that leave the target whole or untouched, with checks before and checksums after."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The list of a release's files, and files that are no part of it.
INVENTORY, HIDDEN = "inventory", r"(^|/)[._]"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _swap(spark: SparkSession, stage: str, target: str, backup: bool = False) -> None:
    """stage in the place of target; a failure leaves the target as it was and no stage.

    With backup the former one stays at target.bak, one generation. Stores without an atomic rename have a moment
    without the target between the two renames.
    """
    old = f"{target}.bak" if backup else f"{target}.old-{uuid.uuid4().hex}"
    fs, at = _fs(spark, target)
    staged, former = _fs(spark, stage)[1], _fs(spark, old)[1]
    had = fs.exists(at)
    if had:
        fs.delete(former, True)
        if not fs.rename(at, former):
            fs.delete(staged, True)
            raise OSError(f"{target} can't be moved")
    if not fs.rename(staged, at):
        if had:
            fs.rename(former, at)
        fs.delete(staged, True)
        raise OSError(f"{stage} can't be moved to {target}")
    if had and not backup:
        fs.delete(former, True)


def replace(df: DataFrame, target: str, check: Callable[[DataFrame], None] | None = None, backup: bool = False) -> None:
    """Writes beside the target, checks what was written, then renames; a failure leaves the target as it was."""
    spark, stage = df.sparkSession, f"{target}.stage-{uuid.uuid4().hex}"
    try:
        df.write.parquet(stage)
        if check:
            check(spark.read.parquet(stage))
    except BaseException:
        _fs(spark, stage)[0].delete(_fs(spark, stage)[1], True)
        raise
    _swap(spark, stage, target, backup)


def rebuild(fresh: DataFrame, target: str, by: str, scope: list, key: list[str], report: str | None = None) -> DataFrame:
    """Builds the partitions of target whose column by has a value of scope anew from fresh; the others keep their files.

    Returns by and key of the rows that these partitions had and fresh lacks, found in the same run before anything is
    written over, and kept at report (target.dropped if that isn't given). fresh may read target, and must hold no row
    beyond scope, null included. A partition of scope without fresh rows goes. What was made is staged first, so a
    rebuild that broke off is repeated with the same fresh rows.
    """
    spark, stage, report = fresh.sparkSession, f"{target}.stage-{uuid.uuid4().hex}", report or f"{target}.dropped"
    fs, staged = _fs(spark, stage)
    try:
        fresh.write.parquet(stage)
        new = spark.read.parquet(stage)
        within = F.coalesce(F.col(by).isin(*scope), F.lit(False)) if scope else F.lit(False)
        if beyond := new.where(~within).select(by).limit(1).collect():
            raise ValueError(f"{by} {beyond[0][0]!r} is beyond the scope")
        gone = []
        if fs.exists(_fs(spark, target)[1]):
            old = spark.read.schema(new.schema).parquet(target).where(within)
            old.join(new, [by, *key], "left_anti").select(by, *key).write.mode("overwrite").parquet(report)
            folders = old.select(by, F.regexp_replace("_metadata.file_path", "/[^/]+$", "").alias("folder")).distinct()
            gone = [r["folder"] for r in folders.join(new.select(by).distinct(), by, "left_anti").collect()]  # one a partition
        else:
            new.limit(0).select(by, *key).write.mode("overwrite").parquet(report)
        if scope:
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(target)
        for path in gone:
            fs.delete(_fs(spark, path)[1], True)
    finally:
        fs.delete(staged, True)
    return spark.read.parquet(report)


def replace_json(df: DataFrame, target: str) -> None:
    """A small frame as one file of JSON lines at target, whole or not at all."""
    spark, stage = df.sparkSession, f"{target}.stage-{uuid.uuid4().hex}"
    fs, staged = _fs(spark, stage)
    try:
        df.coalesce(1).write.json(stage)
        part = [f.getPath() for f in fs.listStatus(staged) if f.getPath().getName().startswith("part-")]
        single = f"{target}.one-{uuid.uuid4().hex}"
        if part:
            fs.rename(part[0], _fs(spark, single)[1])
        else:
            fs.create(_fs(spark, single)[1]).close()
        _swap(spark, single, target)
    finally:
        fs.delete(staged, True)


def bundle(spark: SparkSession, tables: dict[str, DataFrame], target: str, problems: Callable[[dict[str, DataFrame]], DataFrame], resume: str | None = None) -> None:
    """Tables as one release below target: all staged, checked as written, listed with their digests, then swapped in.

    problems gives rows of issue and what from the staged tables. If there are any, the target stays as it was, what was
    staged goes to resume if that is given, for a later run to go on from, and the job ends with an error that names the
    issues. After the swap the files are read again and held against the list.
    """
    stage = f"{target}.stage-{uuid.uuid4().hex}"
    fs, staged = _fs(spark, stage)
    try:
        for name, df in tables.items():
            df.write.parquet(f"{stage}/{name}")
        found = problems({name: spark.read.parquet(f"{stage}/{name}") for name in tables}).groupBy("issue").count().collect()
        if not found:
            checksums(spark, stage, HIDDEN).coalesce(1).write.parquet(f"{stage}/{INVENTORY}")
    except BaseException:
        fs.delete(staged, True)
        raise
    if found:
        if resume:
            _swap(spark, stage, resume)
        fs.delete(staged, True)
        raise ValueError("not released: " + ", ".join(sorted(f"{r['issue']} ({r['count']})" for r in found)))
    _swap(spark, stage, target)
    if wrong := bundle_differences(spark, target).limit(3).collect():
        raise ValueError(f"released files differ from their list: {wrong}")


def bundle_differences(spark: SparkSession, target: str) -> DataFrame:
    """path and status of the files of a release that aren't as its list says."""
    return verify(spark, target, spark.read.parquet(f"{target}/{INVENTORY}"), f"{HIDDEN}|^{INVENTORY}/")


def resumed(spark: SparkSession, resume: str, name: str) -> DataFrame | None:
    """A table that an incomplete run left, if there is one."""
    fs, at = _fs(spark, f"{resume}/{name}")
    return spark.read.parquet(f"{resume}/{name}") if fs.exists(at) else None


def scored_pair(metrics: DataFrame, predictions: DataFrame, truth: DataFrame, key: str, target: str) -> None:
    """Metrics and predictions, written only if predictions has each key of truth once and no other."""
    if predictions.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("repeated ids")
    if predictions.join(truth, key, "left_anti").limit(1).count() or truth.join(predictions, key, "left_anti").limit(1).count():
        raise ValueError("predictions and truth differ in their ids")
    replace(predictions, f"{target}/predictions")
    replace(metrics, f"{target}/metrics")


#: Bytes of a file up to which Spark reads it as one value; larger ones are read piece by piece.
WHOLE, PIECE = 64 << 20, 4 << 20


def checksums(spark: SparkSession, root: str, leave_out: str = "^$", whole: int = WHOLE) -> DataFrame:
    """path below root and sha256 of every file, of any size; paths that fit leave_out are no part.

    Spark's reader passes over empty files and those whose names begin with _ or a dot.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = _fs(spark, root)[0].makeQualified(_fs(spark, root)[1]).toUri().getPath().rstrip("/")

    def streamed(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        from gridloom.sources.npy import opened

        for b in batches:
            digests = []
            for path in b.column("path").to_pylist():
                told = hashlib.sha256()
                with opened(path) as f:
                    while piece := f.read(PIECE):
                        told.update(piece)
                digests.append(told.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(digests, pa.string())], names=["path", "digest"])

    large = files.where(F.col("length") > whole).select("path").mapInArrow(streamed, "path string, digest string")
    all_ = files.where(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("digest")).unionByName(large)
    below = F.expr(f"substring(path, locate('{base}/', path) + {len(base) + 1})")
    return all_.select(below.alias("path"), "digest").where(~F.col("path").rlike(leave_out))


def verify(spark: SparkSession, root: str, expected: DataFrame, leave_out: str = "^$") -> DataFrame:
    from gridloom.operators.quality import difference

    return difference(expected, checksums(spark, root, leave_out), "path", "digest")


def append_csv(df: DataFrame, target: str) -> None:
    df.write.mode("append").option("header", "true").csv(target)


def sorted_manifest(df: DataFrame, target: str) -> None:
    """A small list in order of date and id, as one file."""
    df.orderBy("date", "id").coalesce(1).write.mode("overwrite").json(target)
