"""Centroid clustering of vectors of whole numbers by scalar lookup tables.

Vectors are stored once in blocks, each number as its place in the list of the numbers that occur in its dimension of
the block. A round tabulates, for each dimension, occurring number and centroid, the squared difference; a vector's
distances are then gathered from the table and summed, without a multiplication. Each task adds up the vectors of
each centroid; one row a centroid and dimension reaches the driver, which rounds the means exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, stored, table

#: Components of a vector, steps of a unit, centroids, rounds, salt of the hash that chooses the first centroids.
DIMS, SCALE, CENTROIDS, ROUNDS, SALT = 64, 1024, 8, 10, 3
#: Vectors of a block: a table has at most so many rows for each dimension.
BLOCK = 4096
#: Whole numbers beyond this count as this; squared distances of 64 of them are the most that fits 64 bits.
MOST = 1 << 27


def whole(df: DataFrame, dims: int = DIMS, scale: int = SCALE, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v, the components as floor(scale * x), of each row whose vector has dims components, none null or non-finite."""
    x = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(x, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    held = lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x * scale, F.lit(float(MOST))), F.lit(float(-MOST)))), F.lit(MOST)), F.lit(-MOST))
    rows = df.select(F.col(id_).cast("long").alias("id"), x.alias("x")).where(F.coalesce((F.size("x") == dims) & finite, F.lit(False)))
    return rows.select("id", F.transform("x", lambda x: held(x).cast("int")).alias("v"))


def _coded(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of vectors: ids, codes (the place of each number in its dimension's list), values (these lists) and sizes (their lengths)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                lists, codes = zip(*[np.unique(v[:, d], return_inverse=True) for d in range(dims)], strict=True)
                packed = np.stack(codes).astype("<u2").tobytes(), np.concatenate(lists).astype("<i4").tobytes(), np.array([len(x) for x in lists], "<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), *[pa.array([x], pa.binary()) for x in packed]], names=["ids", "codes", "values", "sizes"]
                )

    return rows.mapInArrow(run, "ids array<bigint>, codes binary, values binary, sizes binary")


def _blocks(batches: Iterator, dims: int) -> Iterator:
    """Of each block its ids (None for none), the rows of the table that its numbers stand for (dims x n), and the table's numbers and dimensions."""
    for b in batches:
        for ids, codes, values, sizes in zip(*[b.column(c).to_pylist() for c in ("ids", "codes", "values", "sizes")], strict=True):
            sizes = np.frombuffer(sizes, "<i4")
            before = np.cumsum(sizes) - sizes
            rows = np.frombuffer(codes, "<u2").reshape(dims, -1) + before[:, None]
            yield ids, rows, np.frombuffer(values, "<i4").astype(np.int64), np.repeat(np.arange(dims), sizes)


def _assigned(rows: np.ndarray, values: np.ndarray, dim: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector, the smaller number on a tie, and its squared distance."""
    squared = (values[:, None] - centroids.T[dim]) ** 2
    total = np.zeros((rows.shape[1], len(centroids)), np.int64)
    for of_dim in rows:
        total += squared[of_dim]
    near = total.argmin(1)
    return near, total[np.arange(len(total)), near]


def _sums(blocks: DataFrame, centroids: np.ndarray) -> list:
    """centroid, dimension (-1: the distances), sum and count, over all vectors; one row of each task for each is added up."""
    dims = centroids.shape[1]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums, counts = np.zeros((len(centroids), dims + 1), object), np.zeros(len(centroids), np.int64)
        for _, rows, values, dim in _blocks(batches, dims):
            near, far = _assigned(rows, values, dim, centroids)
            numbers = values[rows]
            for c in np.unique(near):
                own = near == c
                sums[c] += [*numbers[:, own].sum(1).tolist(), sum(far[own].tolist())]
                counts[c] += own.sum()
        c, d = np.nonzero(np.repeat(counts[:, None], dims + 1, 1))
        d = np.where(d == dims, -1, d)
        from decimal import Decimal

        made = pa.array([Decimal(int(s)) for s in sums[c, d]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int32()), made, pa.array(counts[c], pa.int64())], names=["c", "d", "s", "n"])

    return blocks.mapInArrow(run, "c int, d int, s decimal(38,0), n bigint").groupBy("c", "d").agg(F.sum("s").cast("decimal(38,0)"), F.sum("n")).collect()


def first_centroids(rows: DataFrame, k: int, salt: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of salt:id, in its order; equal ids in the order of their vectors, rows without an id last."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).asc_nulls_last()
    return np.array([r["v"] for r in rows.orderBy(by, "v").limit(k).collect()], np.int64)


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: int = SALT, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each row that is kept.

    Rows whose vector is null, of another length, or holds null or non-finite components are left out; every other
    row, repeated ones and those without an id too, gives one. Fewer than k rows give fewer centroids, none no rows.
    Numbers beyond MOST either way count as MOST; a sum of distances beyond 64 bits as the greatest long. Other columns
    aren't looked at.
    """
    import hashlib

    importable(df.sparkSession)
    rows = whole(df, dims, scale, id_, vector)
    centroids = first_centroids(rows, k, salt)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        return df.sparkSession.createDataFrame([], schema)
    blocks = stored(_coded(rows, dims), "blocks")
    for _ in range(rounds):
        moved = centroids.copy()
        for c, d, s, n in _sums(blocks, centroids):
            if d >= 0:
                moved[c, d] = int(s) // n
        centroids = moved
    longest = (1 << 63) - 1
    inertia = {c: int(s) for c, d, s, _ in _sums(blocks, centroids) if d < 0}
    own = [min(inertia.get(c, 0), longest) for c in range(len(centroids))]
    total = min(sum(inertia.values()), longest)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for ids, numbers, values, dim in _blocks(batches, dims):
            near, far = _assigned(numbers, values, dim, centroids)
            made = pa.array(ids, pa.int64()), pa.array(near, pa.int32()), pa.array(far, pa.int64()), pa.array([own[c] for c in near], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*made, pa.array([total] * len(ids), pa.int64()), pa.array([digest[c] for c in near], pa.string())], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
            )

    return blocks.mapInArrow(run, schema)


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every embedding of 64 finite components."""
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: int = SALT) -> str:
    """The rounds one below the other."""
    far = "list_sum(list_transform(list_zip(v, w), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"

    def met(n: int) -> str:
        return f"a{n} AS MATERIALIZED (SELECT vec_id, row, v, arg_min(c, (far, c)) AS c, min(far) AS far FROM (SELECT vec_id, row, v, c, CAST({far} AS BIGINT) AS far FROM kept, c{n}) GROUP BY 1, 2, 3)"

    def moved(n: int) -> str:
        return f"""m{n} AS (SELECT c, i, CAST(sum(v[i]) AS HUGEINT) AS s, count(*) AS n FROM a{n - 1}, range(1, {dims + 1}) t(i) GROUP BY 1, 2),
c{n} AS MATERIALIZED (SELECT o.c, coalesce(any_value(x.w), any_value(o.w)) AS w FROM c{n - 1} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS w FROM m{n} GROUP BY 1) x USING (c) GROUP BY 1)"""

    steps = ",\n".join(f"{met(n - 1)},\n{moved(n)}" for n in range(1, rounds + 1))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = {dims}
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS w FROM (SELECT sha256('{salt}:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k})
),
{steps},
{met(rounds)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(w, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON a.c = k.c
"""


OP12_SQL = _sql()
