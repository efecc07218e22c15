"""Registered queries: clock readings against timelines. Users are games, their events in order the places."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators import alignment
from gridloom.plans.registry import query, table

#: Places of each user's events, and readings: every purchase reads the clocks of its place, a little off.
PLACES = """
e AS (SELECT user_id AS game, user_id % 4 AS round, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply,
      CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS clk FROM events),
f AS (SELECT *, lag(clk) OVER (PARTITION BY game ORDER BY ply) AS before FROM e),
p AS (SELECT game, round, event_id, event_type, ply, CASE WHEN ply % 2 = 0 THEN 'black' ELSE 'white' END AS turn, CASE WHEN ply % 2 = 0 THEN clk ELSE before END
    AS white_clk, CASE WHEN ply % 2 = 0 THEN before ELSE clk END AS black_clk FROM f),
n AS (SELECT *, CASE WHEN turn = 'white' THEN lead(white_clk) OVER (PARTITION BY game ORDER BY ply) ELSE lead(black_clk) OVER (PARTITION BY game ORDER BY ply)
    END AS nx FROM p),
o AS (SELECT event_id AS obs_id, round, game AS own, CASE WHEN event_id % 11 = 0 THEN black_clk ELSE white_clk + event_id % 4 - 1 END AS white_obs, CASE WHEN
    event_id % 11 = 0 THEN white_clk ELSE black_clk - event_id % 3 END AS black_obs FROM p WHERE event_type = 'purchase'),
r AS (SELECT *, CASE WHEN turn = 'black' THEN white_clk ELSE black_clk END AS rec, CASE WHEN turn = 'black' THEN black_clk ELSE white_clk END AS now FROM n
    WHERE white_clk IS NOT NULL AND black_clk IS NOT NULL),
m AS (SELECT obs_id, own, game, ply, CASE WHEN turn = 'black' THEN 'white' ELSE 'black' END AS side, abs(CASE WHEN turn = 'black' THEN white_obs ELSE black_obs
    END - rec) AS residual FROM o JOIN r USING (round)
WHERE abs(CASE WHEN turn = 'black' THEN white_obs ELSE black_obs END - rec) <= 2 AND CASE WHEN turn = 'black' THEN black_obs ELSE white_obs END BETWEEN
    coalesce(nx - 1, 0) - 3 AND now + 3)
"""


def _places(spark, sf_dir):
    w = Window.partitionBy("game").orderBy("ts", "event_id")
    clk = F.when(F.col("event_type") != "error", F.floor("value"))
    e = (
        table(spark, sf_dir, "events")
        .select(F.col("user_id").alias("game"), (F.col("user_id") % 4).alias("round"), "event_id", "event_type", "ts", clk.alias("clk"))
    )
    e = e.withColumn("ply", (F.row_number().over(w) - 1).cast("long")).withColumn("before", F.lag("clk").over(w))
    even = F.col("ply") % 2 == 0
    return e.select(
        "game", "round", "event_id", "event_type", "ply", F.when(even, "black").otherwise("white").alias("turn"), F.lit(1).alias("increment"),
        F.when(even, F.col("clk")).otherwise(F.col("before")).alias("white_clk"), F.when(even, F.col("before")).otherwise(F.col("clk")).alias("black_clk"),
    )


def _readings(places):
    """Clocks a little off; those of every eleventh id are swapped."""
    swapped = F.col("event_id") % 11 == 0
    white = F.when(swapped, F.col("black_clk")).otherwise(F.col("white_clk") + F.col("event_id") % 4 - 1)
    black = F.when(swapped, F.col("white_clk")).otherwise(F.col("black_clk") - F.col("event_id") % 3)
    return (
        places.where("event_type = 'purchase'")
        .select(F.col("event_id").alias("obs_id"), "round", "game", white.alias("white_obs"), black.alias("black_obs"))
    )


@query(f"WITH {PLACES} SELECT obs_id, game, ply, side, CAST(residual AS DOUBLE) AS residual FROM m WHERE own = game")
def clock_places(spark, sf_dir):
    """Places of a reading's own game whose still clock is within 2 and whose running clock is between the next value and its own."""
    p = _places(spark, sf_dir).drop("round")
    return alignment.clock_matches(
        _readings(p.withColumn("round", F.lit(0))).withColumnRenamed("game", "own").drop("round").withColumn("g", F.col("own")),
        p.withColumn("g", F.col("game")),
        ["g"],
    )


@query(f"""
WITH {PLACES}, k AS (SELECT obs_id, obs_id % 3 <> 0 AS named FROM o),
c AS (SELECT obs_id, game, ply, residual, 0.5e0 * greatest(0, 1 - residual / 2e0) + CASE WHEN named THEN 0.5e0 ELSE 0e0 END AS confidence FROM m JOIN k USING
    (obs_id) WHERE NOT named OR (game = own AND obs_id % 9 <> 1)),
b AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY confidence DESC, game, residual, ply) AS n FROM c)
SELECT o.obs_id, b.game, b.ply, CAST(b.residual AS DOUBLE) AS residual, confidence FROM o LEFT JOIN b ON b.obs_id = o.obs_id AND n = 1
""")
def identified_place(spark, sf_dir):
    """The best place of a round's games; two thirds of the readings have names, and some of these fit no game."""
    p = _places(spark, sf_dir)
    o = _readings(p).withColumn("names_read", F.col("obs_id") % 3 != 0)
    named = o.where("names_read and obs_id % 9 <> 1").select("obs_id", "game")
    return alignment.identify(o.drop("game"), p, ["round"], named)


@query("""
WITH e AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 9 AS c, row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) ORDER BY ts,
    event_id) AS k, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events),
g AS (SELECT user_id, day, count(*) AS n, max(CASE WHEN k <= 2 AND c = 0 THEN 1 ELSE 0 END) AS zero FROM e GROUP BY 1, 2)
SELECT user_id, day, n >= 2 AND zero = 0 AS usable FROM g
""")
def usable_clocks(spark, sf_dir):
    """The readings of a user's day: two at least, neither of the first two zero."""
    e = (
        table(spark, sf_dir, "events")
        .select(
            "user_id",
            "ts",
            "event_id",
            F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day"),
            (F.floor("value") % 9).alias("c"),
        )
    )
    listed = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "c"))).alias("r"))
    return listed.select("user_id", "day", alignment.usable(F.transform("r", lambda x: x["c"])).alias("usable"))
