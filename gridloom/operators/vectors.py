"""Centroids, nearest centroid with junk and blank outcomes, weighted neighbours, leader clusters, principal axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.text import dot, unit
from gridloom.llm.common import shared_dir, stored


#: Likenesses of queries and rows that a task works out at once: 8 MB, and a few times that beside it.
CELLS = 1 << 20


def centroids(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """key and centroid: the unit vector along the sum of a key's vectors; one row a key reaches each task's sum."""
    parts = df.select(key, F.posexplode(vector).alias("d", "x")).groupBy(key, "d").agg(F.sum(F.col("x").cast("double")).alias("x"))
    return (
        parts.groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v"))
        .select(key, unit(F.transform("v", lambda p: p["x"])).alias("centroid"))
    )


def nearest_centroid(
    df: DataFrame, cents: DataFrame, key: str, vector: str = "embedding", most: int = 10_000, block: int = 4096
) -> DataFrame:
    """df with best, a struct of similarity and key of the centroid nearest by cosine; the least key on a tie.

    Up to `most` centroids travel as one broadcast array; more are held against the rows in blocks of both, with
    the same result. A column named best is replaced.
    """
    n = cents.count()
    if n > most:
        return _nearest_in_blocks(df, cents, key, vector, -(-n // block))
    listed = cents.agg(F.array_sort(F.collect_list(F.struct(key, "centroid"))).alias("_c"))
    scored = F.transform("_c", lambda c: F.struct(F.round(-dot(F.col(vector), c["centroid"]), 6).alias("minus"), c[key].alias(key)))
    met = df.join(F.broadcast(listed)).withColumn("_b", F.array_min(scored))
    return met.withColumn("best", F.struct((-F.col("_b.minus")).alias("similarity"), F.col(f"_b.{key}").alias(key))).drop("_c", "_b")


def _nearest_in_blocks(df: DataFrame, cents: DataFrame, key: str, vector: str, blocks: int) -> DataFrame:
    """Every row meets every block of centroids; the best of each block reaches the row again."""
    size = 4096
    held = max(1, -(-df.count() // size))
    rows = df.select(F.struct("*").alias("row"), F.col(vector).alias("v")).withColumn("rb", F.pmod(F.xxhash64("v"), F.lit(held)))
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    asked = rows.select("id", "v", "rb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    place = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("cb")
    offered = cents.select(F.col(key).alias("k"), F.col("centroid").alias("c"), place, F.explode(F.sequence(F.lit(0), F.lit(held - 1))).alias("rb"))
    kind = dict(cents.dtypes)[key]

    def near(left, right):
        import pandas as pd

        if left.empty or right.empty:
            return pd.DataFrame({"id": [], "s": [], "k": []})
        right = right.sort_values("k")
        sim = np.round(np.stack(left["v"].to_numpy()).astype(float) @ np.stack(right["c"].to_numpy()).astype(float).T, 6)
        best = sim.argmax(1)
        return pd.DataFrame({"id": left["id"], "s": sim[np.arange(len(sim)), best], "k": right["k"].to_numpy()[best]})

    found = asked.groupBy("rb", "cb").cogroup(offered.groupBy("rb", "cb")).applyInPandas(near, f"id long, s double, k {kind}")
    best = found.groupBy("id").agg(F.min(F.struct((-F.col("s")).alias("minus"), "k")).alias("b"))
    made = F.struct((-F.col("b.minus")).alias("similarity"), F.col("b.k").alias(key)).alias("best")
    return rows.select("id", "row").join(best, "id").select(*[F.col(f"row.`{c}`") for c in df.columns if c != "best"], made)


def _led(items: list[tuple[np.ndarray, int, int]], most: float, given: int = 0) -> list[tuple[np.ndarray, int, int]]:
    """(sum, count, first) of the clusters of such items, taken in turn: each joins the nearest cluster within most, or leads.

    The first `given` items are clusters already.
    """
    if not items:
        return []
    sums = np.zeros((len(items), len(items[0][0])))
    units, counts, firsts, n = np.zeros_like(sums), [], [], 0
    for k, (v, many, first) in enumerate(items):
        near = units[:n] @ (v / np.linalg.norm(v))
        at = int(near.argmax()) if n else -1
        if n and k >= given and 1 - near[at] <= most:
            counts[at] += many
        else:
            at, n = n, n + 1
            counts.append(many)
            firsts.append(first)
        sums[at] += v
        units[at] = sums[at] / np.linalg.norm(sums[at])
    return list(zip(sums[:n], counts, firsts, strict=True))


def leader_clusters(df: DataFrame, order: str, vector: str, most: float, rows: int = 512, fan: int = 16) -> DataFrame:
    """cluster (the least order in it), centroid and n of the clusters of unit vectors by greedy leaders.

    order is a whole number and names a row. Pieces of rows consecutive numbers are clustered in order, a vector joining the
    nearest running mean within most or leading anew; then the clusters' sums of fan pieces at a time are, and so on
    until one piece is left. Up to `rows` numbers that is one pass over all; of more, every level is the same rule
    on the sums below it. A task holds one piece's vectors, or fan pieces' clusters. A vector without length
    belongs to no cluster.
    """
    last = df.agg(F.max(F.floor(F.col(order) / rows))).first()[0]
    kind = "piece long, first long, n long, total array<double>"

    def lead(part):
        import pandas as pd

        part = part.sort_values("first")
        done = _led([(np.asarray(v, float), int(n), int(f)) for v, n, f in zip(part["total"], part["n"], part["first"], strict=True)], most)
        return pd.DataFrame(
            {"piece": part["piece"].iloc[0], "first": [f for *_, f in done], "n": [n for _, n, _ in done], "total": [v.tolist() for v, *_ in done]},
        )

    size = F.sqrt(dot(F.col(vector), F.col(vector)))
    start = (
        df.where(size >= 1e-6)
        .select(
            F.floor(F.col(order) / rows).alias("piece"),
            F.col(order).cast("long").alias("first"),
            F.lit(1).cast("long").alias("n"),
            unit(F.col(vector)).alias("total"),
        )
    )
    now, pieces = start.groupBy("piece").applyInPandas(lead, kind), (last or 0) + 1
    while pieces > 1:
        now = now.withColumn("piece", F.floor(F.col("piece") / fan)).groupBy("piece").applyInPandas(lead, kind)
        pieces = -(-pieces // fan)
    return now.select(F.col("first").alias("cluster"), unit(F.col("total")).alias("centroid"), "n")


def leaders_in_turn(df: DataFrame, order: str, vector: str, most: float, rows: int = 65_536) -> DataFrame:
    """cluster (the least order in it), centroid and n of the clusters of unit vectors by greedy leaders over all, in order.

    order is a whole number and names a row. A vector joins the nearest running mean within most or leads anew, so each
    waits for all before it: pieces of about `rows` vectors are taken one after the other, a piece in a task together
    with the clusters so far, which are all that a piece hands on. A vector without length belongs to no cluster.
    """

    def lead(part):
        import pandas as pd

        part = part.sort_values(["held", "first"], ascending=[False, True])
        items = [(np.asarray(v, float), int(n), int(f)) for v, n, f in zip(part["total"], part["n"], part["first"], strict=True)]
        done = _led(items, most, int(part["held"].sum()))
        return pd.DataFrame({"first": [f for *_, f in done], "n": [n for _, n, _ in done], "total": [v.tolist() for v, *_ in done]})

    led = lambda some: some.groupBy().applyInPandas(lead, "first long, n long, total array<double>")
    size = F.sqrt(dot(F.col(vector), F.col(vector)))
    start = (
        df.where(size >= 1e-6)
        .select(F.col(order).cast("long").alias("first"), F.lit(1).cast("long").alias("n"), unit(F.col(vector)).alias("total"), F.lit(False).alias("held"))
    )
    count = start.count()
    if count <= rows:
        now = led(start)
    else:
        path = shared_dir(df.sparkSession, "pieces")
        start.repartitionByRange(-(-count // rows), "first").withColumn("piece", F.spark_partition_id()).write.partitionBy("piece").parquet(path)
        pieces, now = df.sparkSession.read.parquet(path), None
        turns: list[list[int]] = []  # first and last piece and the rows of a turn, as the pieces may be smaller than asked for
        for piece, n in sorted(pieces.groupBy("piece").count().collect()):
            if turns and turns[-1][2] + n <= rows:
                turns[-1][1:] = [piece, turns[-1][2] + n]
            else:
                turns.append([piece, piece, n])
        for low, high, _ in turns:
            part = pieces.where(F.col("piece").between(low, high)).drop("piece")
            now = stored(led(part if now is None else part.unionByName(now.withColumn("held", F.lit(True)))), "leaders")
    return now.select(F.col("first").alias("cluster"), unit(F.col("total")).alias("centroid"), "n")


def neighbour_score(queries: DataFrame, rows: DataFrame, k: int, label: str = "label", id_: str = "vec_id", vector: str = "embedding", block: int = 4096, most_bytes: int = 16 << 20) -> DataFrame:
    """id, neighbours and score: the mean label of the k nearest rows by cosine, weighted by it where positive.

    Queries, a stated set, of up to most_bytes travel to all tasks, and each gives at most k of its rows a query; more
    are held in blocks against all rows in blocks, `block` of either in a task on average, with the same result. Without
    a positive weight the plain mean is the score. A query isn't its own neighbour; the least id wins a tie.
    """
    size = queries.agg(F.sum(F.size(vector) * 8 + 8)).first()[0] or 0
    found = _near_all(queries, rows, k, label, id_, vector) if size <= most_bytes else _near_in_blocks(queries, rows, k, label, id_, vector, block)
    top = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "other"))).where(F.col("n") <= k)
    weight = F.greatest(F.col("sim"), F.lit(0.0))
    return (
        top.groupBy("q")
        .agg(
            F.count("*").alias("neighbours"),
            F.round(F.when(F.sum(weight) > 0, F.sum(weight * F.col("y")) / F.sum(weight)).otherwise(F.avg("y")), 4).alias("score"),
        )
        .withColumnRenamed("q", id_)
    )


def _stacked(column) -> np.ndarray:
    """The vectors of an Arrow column of lists of one length."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _near_all(queries: DataFrame, rows: DataFrame, k: int, label: str, id_: str, vector: str) -> DataFrame:
    """q, sim, other and y of the k nearest rows of each task to each query; CELLS likenesses at once, however many queries."""
    held = queries.select(F.col(id_).cast("long").alias("q"), vector).toArrow()
    ids, asked = held.column("q").to_numpy(), _stacked(held.column(vector)) if held.num_rows else np.zeros((0, 1))

    def nearest(rows_: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort((rows_[2], -rows_[1], rows_[0]))
        order = order[np.arange(len(order)) - np.searchsorted(rows_[0][order], rows_[0][order]) < k]
        return [x[order] for x in rows_]

    def near(batches: Iterator) -> Iterator:
        import pyarrow as pa

        best = [np.zeros(0, t) for t in (np.int64, float, np.int64, float)]
        for b in batches:
            if b.num_rows and len(ids):
                own, y, v = b.column("other").to_numpy(), b.column("y").to_numpy(), _stacked(b.column("v"))
                found, step = [best], max(1, CELLS // len(own))
                for lo in range(0, len(ids), step):
                    some = ids[lo : lo + step]
                    sim = np.round(asked[lo : lo + step] @ v.T, 6)
                    sim[some[:, None] == own] = -2
                    at = np.argpartition(-sim, min(k, len(own) - 1), axis=1)[:, :k] if len(own) > k else np.tile(np.arange(len(own)), (len(some), 1))
                    least = np.take_along_axis(sim, at, 1).min(1, keepdims=True)
                    q, j = np.nonzero((sim >= least) & (sim > -2))  # with all that tie
                    found.append(nearest([some[q], sim[q, j], own[j], y[j]]))
                best = nearest([np.concatenate(x) for x in zip(*found, strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], names=["q", "sim", "other", "y"])

    own = rows.select(F.col(id_).cast("long").alias("other"), F.col(vector).alias("v"), F.col(label).cast("double").alias("y"))
    return own.mapInArrow(near, "q bigint, sim double, other bigint, y double")


def _near_in_blocks(queries: DataFrame, rows: DataFrame, k: int, label: str, id_: str, vector: str, block: int) -> DataFrame:
    """q, sim, other and y of the k nearest rows of each block to each query."""
    parts = lambda df: max(1, -(-df.count() // block))
    asked, held = parts(queries), parts(rows)
    place = lambda n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.col(id_).cast("long").alias("q"), F.col(vector).alias("v"), place(asked).alias("qb"), every(held).alias("rb"))
    r = rows.select(
        F.col(id_).cast("long").alias("other"),
        F.col(vector).alias("v"),
        F.col(label).cast("double").alias("y"),
        every(asked).alias("qb"),
        place(held).alias("rb"),
    )

    def near(left, right):
        import pandas as pd

        if left.empty or right.empty:
            return pd.DataFrame({"q": [], "sim": [], "other": [], "y": []})
        right = right.sort_values("other")  # the least id first on a tie
        own, ids = right["other"].to_numpy(), left["q"].to_numpy()
        sim = np.round(np.stack(left["v"].to_numpy()).astype(float) @ np.stack(right["v"].to_numpy()).astype(float).T, 6)
        sim[ids[:, None] == own[None, :]] = -2
        best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        frame = pd.DataFrame(
            {"q": np.repeat(ids, best.shape[1]), "sim": np.take_along_axis(sim, best, 1).ravel(), "other": own[best].ravel(), "y": right["y"].to_numpy()[best].ravel()},
        )
        return frame[frame["sim"] > -2]

    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(near, "q bigint, sim double, other bigint, y double")


def principal_axes(df: DataFrame, k: int, vector: str = "embedding") -> tuple[list[float], list[list[float]]]:
    """Mean and first k right singular vectors, in one pass: each task sums its vectors and their products.

    d x (d + 1) numbers of each task are added up on Spark; as many reach the driver, no rows.
    """

    def sums(frames: Iterator) -> Iterator:
        import pandas as pd

        n, total = 0, None
        for part in frames:
            if len(part):
                x = np.stack(part[vector].to_numpy()).astype(float)
                here = np.vstack([x.T @ x, x.sum(0)[None]])
                n, total = n + len(x), here if total is None else total + here
        if n:
            yield pd.DataFrame(
                {"i": np.repeat(np.arange(len(total)), total.shape[1]), "j": np.tile(np.arange(total.shape[1]), len(total)), "s": total.ravel(), "n": n},
            )

    got = (
        df.select(vector)
        .where(F.col(vector).isNotNull())
        .mapInPandas(sums, "i int, j int, s double, n long")
        .groupBy("i", "j")
        .agg(F.sum("s"), F.sum("n"))
        .collect()
    )
    if not got:
        return [], []
    d, n = max(r[1] for r in got) + 1, got[0][3]
    total = np.zeros((d + 1, d))
    for i, j, s, _ in got:
        total[i, j] = s / n
    first = total[d]
    values, axes = np.linalg.eigh(total[:d] - np.outer(first, first))
    top = axes[:, np.argsort(-values)[:k]].T
    top *= np.where(top[np.arange(len(top)), np.abs(top).argmax(1)] < 0, -1, 1)[:, None]  # the greatest part of an axis is positive
    return first.tolist(), top.tolist()
