"""Registered queries: ordered analytics and range joins over the events of users."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text
from gridloom.operators import matching, metrics, timeline
from gridloom.plans.registry import query, table


def events(spark, sf_dir):
    """Events with sec, whole seconds of their time."""
    return table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))


EV = "ev AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"


@query("""
SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS
    BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS carried FROM events
""")
def carry_forward(spark, sf_dir):
    value = F.when(F.col("event_type") == "click", F.col("value"))
    return (
        timeline.carry_forward(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], value, F.lit(-1.0), "carried")
        .select("event_id", "user_id", "carried")
    )


@query("""
WITH s AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM events), m AS (
  SELECT *, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM s WHERE n >= 3)
SELECT event_id, user_id, value FROM m WHERE value >= top - 2
""")
def monotone_filter(spark, sf_dir):
    e = timeline.supported(table(spark, sf_dir, "events"), ["user_id"])
    return timeline.monotone(e, ["user_id"], ["ts", "event_id"], "value").select("event_id", "user_id", "value")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 60 THEN 0 WHEN value > 20 THEN 1 ELSE 2 END,
    CAST(floor(value) AS INT) % 7, CASE WHEN value > 50 THEN NULL ELSE value END DESC NULLS FIRST, ts, event_id) AS k FROM events)
SELECT user_id, event_type, event_id FROM r WHERE k = 1
""")
def keep_best(spark, sf_dir):
    """Order: bucket, fit, margin with null best, time, id."""
    v = F.col("value")
    order = [F.when(v > 60, 0).when(v > 20, 1).otherwise(2), F.floor(v).cast("int") % 7, F.when(v > 50, None).otherwise(v).desc_nulls_first(), F.col("ts"), F.col("event_id")]
    return timeline.keep_best(table(spark, sf_dir, "events"), ["user_id", "event_type"], order).select("user_id", "event_type", "event_id")


@query("""
WITH n AS (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events),
r AS (SELECT user_id, event_id AS ref, CASE WHEN nx IS NULL THEN 0 ELSE least(nx, value) - 3 END AS low, value + 3 AS high FROM n WHERE event_type = 'signup'),
o AS (SELECT user_id, event_id, value FROM events WHERE event_type = 'purchase')
SELECT event_id, ref, round(abs(value - (high - 3)), 6) AS residual FROM o JOIN r USING (user_id) WHERE value BETWEEN low AND high
""")
def next_value_range_join(spark, sf_dir):
    """A reading fits a record if it lies between the next value less 3 (0 if there is none) and its value plus 3."""
    e = timeline.following(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", "nx")
    low = F.when(F.col("nx").isNull(), 0.0).otherwise(F.least("nx", "value") - 3)
    ref = (
        e.where("event_type = 'signup'")
        .select("user_id", F.col("event_id").alias("ref"), low.alias("low"), (F.col("value") + 3).alias("high"))
    )
    obs = e.where("event_type = 'purchase'").select("user_id", "event_id", "value")
    return (
        timeline.range_join(obs, ref, ["user_id"], "value", "low", "high", 20.0)
        .select("event_id", "ref", F.round(F.abs(F.col("value") - (F.col("high") - 3)), 6).alias("residual"))
    )


@query("""
WITH m AS (SELECT event_type, median(value) AS med FROM events WHERE value >= 0.8e0 GROUP BY 1),
d AS (SELECT event_id, e.event_type, m.event_type AS nearest, row_number() OVER (PARTITION BY event_id ORDER BY abs(value - med), m.event_type) AS k FROM events e, m)
SELECT event_id, event_type, nearest, event_type <> nearest AS outlier FROM d WHERE k = 1
""")
def chronology_outliers(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    med = (
        metrics.medians(e.where("value >= 0.8"), "event_type", "value")
        .select(F.col("event_type").alias("of"), F.col("median").alias("med"))
    )
    out = timeline.nearest_of(e, med, "value", "med", "of")
    return out.select(
        "event_id",
        "event_type",
        F.col("nearest.of").alias("nearest"),
        (F.col("event_type") != F.col("nearest.of")).alias("outlier"),
    )


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id FROM r WHERE n <= 10 OR p IN (SELECT CAST(floor(i * n / 10e0) AS BIGINT) FROM range(10) t(i))
""")
def spaced_pick(spark, sf_dir):
    return timeline.spaced(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], 10).select("event_id", "user_id")


@query(f"""
WITH {EV}, s AS (SELECT user_id, min(sec) AS a, max(sec) AS b FROM ev GROUP BY 1), n AS (SELECT *, b - a AS span, CAST(least(greatest(4, ceil((b - a) /
    86400e0)), b - a) AS BIGINT) AS n FROM s)
SELECT user_id, CASE WHEN n <= 1 THEN CAST(floor((a + b) / 2e0) AS BIGINT) ELSE CAST(a + floor(span / CAST(n AS DOUBLE) * (k + 0.5e0)) AS BIGINT) END AS frame
    FROM (SELECT *, unnest(range(greatest(n, 1))) AS k FROM n)
""")
def frame_sampling(spark, sf_dir):
    s = events(spark, sf_dir).groupBy("user_id").agg(F.min("sec").alias("a"), F.max("sec").alias("b"))
    return timeline.sample_frames(s, "a", "b", 86400, 4).select("user_id", "frame")


@query("""
WITH RECURSIVE e AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
d AS (SELECT source, doc_id, i, CAST(0 AS BIGINT) AS lo, n - 1 AS hi, 0 AS depth FROM e WHERE i > 0 AND i < n - 1 UNION ALL
  SELECT source, doc_id, i, CASE WHEN i > (lo + hi) // 2 THEN (lo + hi) // 2 ELSE lo END, CASE WHEN i < (lo + hi) // 2 THEN (lo + hi) // 2 ELSE hi END, depth + 1
  FROM d WHERE i <> (lo + hi) // 2),
a AS (SELECT source, doc_id, i, max(depth) AS depth FROM d GROUP BY 1, 2, 3 UNION ALL SELECT source, doc_id, i, -1 FROM e WHERE i = 0 OR i = n - 1),
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY depth, i) AS turn FROM a)
SELECT source, doc_id, turn FROM (SELECT * FROM r ORDER BY turn, source LIMIT 50)
""")
def round_robin_diversify(spark, sf_dir):
    """A top-50 report: one document of each source in turn, each source's in its spread order."""
    placed = timeline.spread(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])
    return timeline.round_robin(placed, "source", ["place"], 50).select("source", "doc_id", F.col("turn").cast("long").alias("turn"))


@query("""
WITH r AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply, count(*) OVER (PARTITION BY
    user_id) - 1 AS last FROM events),
a AS (SELECT user_id, last, ply FROM r WHERE event_type = 'error' AND value > 100),
w AS (SELECT DISTINCT user_id, unnest(range(greatest(ply - 2, 0), least(ply + 2, last) + 1)) AS ply FROM a)
SELECT user_id, count(*) AS places, string_agg(CAST(ply AS VARCHAR), ',' ORDER BY ply) AS plies FROM w GROUP BY 1
""")
def candidate_window(spark, sf_dir):
    w = Window.partitionBy("user_id")
    r = (
        table(spark, sf_dir, "events")
        .select(
            "user_id",
            "event_type",
            "value",
            (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("ply"),
            (F.count("*").over(w) - 1).alias("last"),
        )
    )
    a = (
        r.where("event_type = 'error' and value > 100")
        .groupBy("user_id")
        .agg(F.collect_list("ply").alias("anchors"), F.first("last").alias("last"))
    )
    window = timeline.window_around(F.col("anchors"), 2, F.col("last"))
    return (
        a.select("user_id", window.alias("w"))
        .select("user_id", F.size("w").cast("long").alias("places"), F.array_join("w", ",").alias("plies"))
    )


@query("""
WITH r AS (SELECT event_id, user_id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply FROM events)
SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ply RANGE BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS around, lag(event_id) OVER
    (PARTITION BY user_id ORDER BY ply) AS last_event FROM r
""")
def neighbourhood(spark, sf_dir):
    w = Window.partitionBy("user_id")
    r = table(spark, sf_dir, "events").withColumn("ply", F.row_number().over(w.orderBy("ts", "event_id")) - 1)
    return r.select(
        "event_id",
        F.round(F.avg("value").over(w.orderBy("ply").rangeBetween(-3, 2)), 6).alias("around"),
        F.lag("event_id").over(w.orderBy("ply")).alias("last_event"),
    )


@query("""
SELECT event_id, sec_text, CAST(h * 3600 + m * 60 + s AS BIGINT) AS clock, CASE WHEN h * 3600 + m * 60 + s >= 3600 THEN CAST(h AS VARCHAR) || ':' || lpad(CAST(m
    AS VARCHAR), 2, '0') ELSE CAST(m AS VARCHAR) END || ':' || lpad(CAST(s AS VARCHAR), 2, '0') AS shown
FROM (SELECT event_id, strftime(ts, '%H:%M:%S') AS sec_text, hour(ts) AS h, minute(ts) AS m, second(ts) AS s FROM events)
""")
def clock_parse(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("sec_text"))
    clock = text.read_clock(F.col("sec_text")).cast("long")
    return e.select("event_id", "sec_text", clock.alias("clock"), text.show_clock(clock).alias("shown"))


@query("""
WITH t AS (SELECT CASE WHEN event_type = 'view' THEN 'bad' ELSE CAST(user_id AS VARCHAR) || '+' || CAST(event_id % 30 AS VARCHAR) END AS control, user_id,
    event_id, event_type FROM events)
SELECT control, CASE WHEN event_type = 'view' THEN NULL ELSE user_id * 60 END AS base, CASE WHEN event_type = 'view' THEN 0 ELSE event_id % 30 END AS increment,
    count(*) AS n FROM t GROUP BY 1, 2, 3
""")
def time_control(spark, sf_dir):
    control = (
        F.when(F.col("event_type") == "view", "bad")
        .otherwise(F.concat(F.col("user_id").cast("string"), F.lit("+"), (F.col("event_id") % 30).cast("string")))
    )
    base, inc = text.time_control(F.col("control"))
    return (
        table(spark, sf_dir, "events")
        .select(control.alias("control"))
        .groupBy("control")
        .agg(F.count("*").alias("n"))
        .select("control", base.cast("long").alias("base"), inc.cast("long").alias("increment"), "n")
    )


@query("""
WITH g AS (SELECT o_custkey AS c, o_orderkey AS k, substr(o_orderpriority, 1, 1) AS p, o_totalprice AS v FROM orders),
o AS (SELECT *, min(k) OVER (PARTITION BY c, p) AS l, count(*) OVER (PARTITION BY c, p) - 1 AS n, lag(k) OVER x AS bk, v - lag(v) OVER x AS bd, lead(k) OVER x
    AS ak, lead(v) OVER x - v AS ad,
      count(*) OVER (PARTITION BY c ORDER BY v RANGE BETWEEN 100000 PRECEDING AND 100000 FOLLOWING) - 1 AS m FROM g WINDOW x AS (PARTITION BY c ORDER BY v, k)),
s AS (SELECT *, min(CASE WHEN k <> l THEN k END) OVER (PARTITION BY c, p) AS s FROM o)
SELECT k AS o_orderkey, CASE WHEN n > 0 THEN CASE WHEN k = l THEN s ELSE l END WHEN bd <= 100000 AND (ad IS NULL OR bd <= ad) THEN bk WHEN ad <= 100000 THEN ak
    END AS match, n > 0 AS oriented, CASE WHEN n > 0 THEN n ELSE m END AS matches FROM s
""")
def best_match_with_fallback(spark, sf_dir):
    """Orders of one customer as records of one game: a match of the same priority, or the nearest price where there is none."""
    g = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.substring("o_orderpriority", 1, 1).alias("p"))
    return matching.best_oriented(g, "o_custkey", "o_orderkey", "p", "o_totalprice", 100000)


@query(f"""
WITH {EV}, u AS (SELECT user_id, event_id, sec, lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS before FROM ev),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR sec - before > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED
    PRECEDING) AS shot FROM u)
SELECT user_id, CAST(shot AS BIGINT) AS shot, min(sec) AS start_sec, max(sec) + 1 AS end_sec, CAST(floor((min(sec) + max(sec) + 1) / 2e0) AS BIGINT) AS
    keyframe, count(*) AS n FROM s GROUP BY 1, 2
""")
def shots(spark, sf_dir):
    """Half-open intervals of events no more than an hour apart, with their middle."""
    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    u = events(spark, sf_dir).withColumn("before", F.lag("sec").over(w))
    s = u.withColumn(
        "shot",
        F.sum(F.when(F.col("before").isNull() | (F.col("sec") - F.col("before") > 3600), 1).otherwise(0))
        .over(w.rowsBetween(Window.unboundedPreceding, 0)),
    )
    return (
        s.groupBy("user_id", "shot")
        .agg(
            F.min("sec").alias("start_sec"),
            (F.max("sec") + 1).alias("end_sec"),
            F.floor((F.min("sec") + F.max("sec") + 1) / 2).alias("keyframe"),
            F.count("*").alias("n"),
        )
    )
