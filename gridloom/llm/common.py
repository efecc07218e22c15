"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the table, over as many tasks as there are cores at least.

    One file of one row group is one task's whatever its size; only tables of fewer files than cores are looked at, and
    dealt out anew if fewer tasks than cores have rows. They are stored so, for rows that come out of a shuffle have no
    order that stays the same when a task is repeated, and operators number them.
    """
    docs, cores = table(spark, sf_dir, "documents").select("doc_id", "text"), spark.sparkContext.defaultParallelism
    if len(docs.inputFiles()) >= cores or docs.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return docs
    return stored(docs.repartition(cores), "documents")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder in one of this application below the shared checkpoint folder, deleted when the application ends.

    Below the warehouse where spark.checkpoint.dir is unset, on a local master only.
    """
    own = f"{ensure_checkpoint_dir(spark)}/gridloom-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(own)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        files.mkdirs(where)
        files.deleteOnExit(where)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a folder below the warehouse only where it is unset, as in tests.

    A cluster that names none gets an error: a path of its own choice need not be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"{master} needs a shared folder in spark.checkpoint.dir")
    own = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a table in the shared folder; what reads it survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z only; lower() would also change other scripts, so it serves texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def constant(values: list, kind: str) -> Column:
    """A literal array that the optimizer folds once, however long."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def row_key() -> Column:
    """Keeps repeated rows apart up to the next shuffle; the scan below gives rows in the same order on a retry."""
    return F.monotonically_increasing_id()


def either(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def tokenizer_file(name: str) -> str:
    """Where the public vocabularies lie; GRIDLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("GRIDLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Rows of an Arrow batch between Spark and Python; texts may be long, so fewer than Spark's default.
BATCH_ROWS, DEFAULT_ROWS = "2000", "10000"


def importable(spark: SparkSession) -> None:
    """Lets local Python workers import this package however the session was started; clusters ship it with --py-files.

    Also sets the rows of an Arrow batch to BATCH_ROWS, unless the session names a number of its own.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held]))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == DEFAULT_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


def slices(frames: Iterator, chars: int) -> Iterator:
    """Slices of Arrow record batches of about so many characters of text; a longer text stands alone."""
    for batch in frames:
        sizes = np.cumsum(batch.column("text").to_pandas().str.len().fillna(0).to_numpy()) // chars
        cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(sizes)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)
