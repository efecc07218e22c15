"""Registered queries: scores, bands, quantiles, costs. Boards are made from the 64 numbers of an embedding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import board, text
from gridloom.operators import matching, metrics, quality, recognition
from gridloom.plans.registry import query, table


def boards(spark, sf_dir: str) -> DataFrame:
    """vec_id, label, truth and pred: a cell is empty for small numbers; pred misreads cells near the limits."""
    e = table(spark, sf_dir, "embeddings")

    def cell(x, low: float, k: int):
        x = x.cast("double")
        return F.when(F.abs(x) < low, 0).otherwise(1 + F.pmod(F.floor(x * k), F.lit(12))).cast("int")

    return e.select(
        "vec_id",
        F.col("label").cast("string").alias("label"),
        F.transform("embedding", lambda x: cell(x, 0.1, 40)).alias("truth"),
        F.transform("embedding", lambda x: cell(x, 0.101, 40)).alias("pred"),
    )


BOARDS_SQL = """
cells AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS label, i - 1 AS cell,
         CASE WHEN abs(x) < 0.1e0 THEN 0 ELSE 1 + CAST(((floor(x * 40) % 12) + 12) % 12 AS INT) END AS t,
         CASE WHEN abs(x) < 0.101e0 THEN 0 ELSE 1 + CAST(((floor(x * 40) % 12) + 12) % 12 AS INT) END AS p
  FROM (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings))
), scored AS (
  SELECT vec_id, label, sum(CAST(t = p AS BIGINT)) AS correct, sum(CAST((t > 0) = (p > 0) AS BIGINT)) AS occupancy_correct,
         sum(CAST(t > 0 AS BIGINT)) AS occupied, sum(CAST(t > 0 AND t = p AS BIGINT)) AS piece_correct
  FROM cells GROUP BY 1, 2
)"""

_WITHIN = ", ".join(f"round(avg(CASE WHEN wrong <= {t} THEN 1e0 ELSE 0e0 END), 6) AS within_{t}" for t in metrics.TOLERANCES)


@query(f"""
WITH e AS (SELECT event_type, CAST(floor(value / 10) AS INT) AS wrong FROM events)
SELECT CASE WHEN grouping(event_type) = 1 THEN 'overall' ELSE event_type END AS event_type, count(*) AS n, round(avg(CAST(wrong AS DOUBLE)), 6) AS mean_wrong, {_WITHIN}
FROM e GROUP BY GROUPING SETS ((event_type), ())
""")
def metrics_tolerance_by_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") / 10).cast("int").alias("wrong"))
    return metrics.with_overall(
        e,
        "event_type",
        F.count("*").alias("n"),
        F.round(F.avg("wrong"), 6).alias("mean_wrong"),
        *metrics.within(F.col("wrong")),
    )


@query(f"""
WITH {BOARDS_SQL}, s AS (SELECT *, 64 - correct AS wrong FROM scored)
SELECT CASE WHEN grouping(label) = 1 THEN 'overall' ELSE label END AS label, count(*) AS n, round(avg(CASE WHEN correct = 64 THEN 1e0 ELSE 0e0 END), 6) AS exact_rate,
       round(CAST(sum(correct) AS DOUBLE) / (count(*) * 64), 6) AS cell_rate, round(CAST(sum(occupancy_correct) AS DOUBLE) / (count(*) * 64), 6) AS occupancy_rate,
       round(CAST(sum(piece_correct) AS DOUBLE) / sum(occupied), 6) AS piece_rate, round(avg(CAST(wrong AS DOUBLE)), 6) AS mean_wrong, {_WITHIN}
FROM s GROUP BY GROUPING SETS ((label), ())
""")
def board_metrics_by_label(spark, sf_dir):
    b = quality.nonempty(boards(spark, sf_dir), "board metrics")
    scored = b.select("label", *[c.alias(n) for n, c in board.score(F.col("pred"), F.col("truth")).items()])
    return metrics.with_overall(scored, "label", *metrics.board_measures())


@query(f"""
WITH {BOARDS_SQL}, d AS (SELECT vec_id, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) AS diff FROM cells WHERE t <> p GROUP BY 1)
SELECT vec_id, CAST(correct AS BIGINT) AS correct, CAST(occupancy_correct AS BIGINT) AS occupancy_correct, CAST(occupied AS BIGINT) AS occupied,
    CAST(piece_correct AS BIGINT) AS piece_correct, coalesce(diff, '') AS diff
FROM scored LEFT JOIN d USING (vec_id)
""")
def board_score(spark, sf_dir):
    b = boards(spark, sf_dir)
    return b.select(
        "vec_id",
        *[c.cast("long").alias(n) for n, c in board.score(F.col("pred"), F.col("truth")).items()],
        F.array_join(board.changed(F.col("pred"), F.col("truth")), ",").alias("diff"),
    )


@query(f"""
WITH {BOARDS_SQL}, r AS (
  SELECT vec_id, cell // 8 AS rank, string_agg(substr('.PNBRQKpnbrqk', t + 1, 1), '' ORDER BY cell) AS s FROM cells GROUP BY 1, 2
), n AS (
  SELECT vec_id, string_agg({"replace(" * 8}s{"".join(f", '{'.' * k}', '{k}')" for k in range(8, 0, -1))}, '/' ORDER BY rank) AS placement FROM r GROUP BY 1
)
SELECT vec_id, placement || ' w - - 0 1' AS position, TRUE AS round_trip, length(placement) - length(replace(placement, '/', '')) + 1 AS ranks FROM n
""")
def board_codec(spark, sf_dir):
    b = boards(spark, sf_dir).select("vec_id", "truth", board.to_position(F.col("truth")).alias("position"))
    return b.select(
        "vec_id",
        "position",
        (board.to_cells(F.col("position")) == F.col("truth")).alias("round_trip"),
        F.size(F.split(board.placement_of(F.col("position")), "/")).cast("long").alias("ranks"),
    )


@query(f"""
WITH {BOARDS_SQL}
SELECT CAST(cell AS BIGINT) AS cell, chr(CAST(97 + cell % 8 AS INT)) || CAST(8 - cell // 8 AS VARCHAR) AS square, count(*) AS boards, sum(CAST(t > 0 AS
    BIGINT))::BIGINT AS occupied,
       sum(CAST((t > 0) <> (p > 0) AS BIGINT))::BIGINT AS occupancy_wrong, sum(CAST(t > 0 AND p > 0 AND t <> p AS BIGINT))::BIGINT AS type_wrong
FROM cells GROUP BY 1, 2
""")
def error_decomposition(spark, sf_dir):
    d = metrics.error_decomposition(boards(spark, sf_dir))
    return d.select(
        F.col("cell").cast("long").alias("cell"),
        board.square_name(F.col("cell")).alias("square"),
        "boards",
        "occupied",
        "occupancy_wrong",
        "type_wrong",
    )


@query(f"""
WITH {BOARDS_SQL}
SELECT coalesce(CASE WHEN t BETWEEN 1 AND 6 THEN 'white' WHEN t > 6 THEN 'black' END, 'none') AS colour,
       coalesce(CASE WHEN t > 0 THEN (['pawn', 'knight', 'bishop', 'rook', 'queen', 'king'])[((t - 1) % 6) + 1] END, 'none') AS kind,
       (cell % 8 + 8 - cell // 8) % 2 = 0 AS light, count(*) AS n
FROM cells GROUP BY 1, 2, 3
""")
def piece_counts(spark, sf_dir):
    c = boards(spark, sf_dir).select(F.posexplode("truth").alias("cell", "t"))
    return (
        c.groupBy(
            F.coalesce(board.colour(F.col("t")), F.lit("none")).alias("colour"),
            F.coalesce(board.kind(F.col("t")), F.lit("none")).alias("kind"),
            board.light(F.col("cell")).alias("light"),
        )
        .agg(F.count("*").alias("n"))
    )


@query(f"""
WITH {BOARDS_SQL}, o AS (SELECT vec_id AS a, cell, p FROM cells WHERE vec_id % 100 = 0), k AS (SELECT vec_id AS b, cell, t FROM cells),
d AS (SELECT a, b, sum(CAST(p <> t AS BIGINT))::BIGINT AS diff FROM o JOIN k USING (cell) GROUP BY 1, 2),
w AS (SELECT a, b, diff, row_number() OVER (PARTITION BY a ORDER BY diff, b) AS n FROM d WHERE diff <= 8)
SELECT v.vec_id AS obs_id, b AS known_id, diff, round(1 - diff / 9e0, 6) AS confidence FROM (SELECT DISTINCT vec_id FROM cells WHERE vec_id % 100 = 0) v LEFT
    JOIN w ON a = vec_id AND n = 1
""")
def hamming_nearest(spark, sf_dir):
    """Boards as read whose id is divisible by 100, a stated query set, against all known boards."""
    b = boards(spark, sf_dir)
    obs = b.where("vec_id % 100 = 0").select(F.col("vec_id").alias("obs_id"), F.col("pred").alias("cells"))
    out = matching.hamming_nearest(obs, b.select(F.col("vec_id").alias("known_id"), F.col("truth").alias("cells")), 8)
    return out.select("obs_id", "known_id", F.col("diff").cast("long").alias("diff"), F.round("confidence", 6).alias("confidence"))


@query("""
WITH c AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    f(fraction) AS (VALUES (0.1e0), (0.5e0), (0.9e0), (1e0))
SELECT event_type, fraction, value FROM c, f WHERE k = least(n, CAST(floor(fraction * n) AS BIGINT) + 1)
""")
def quantile_nearest_rank(spark, sf_dir):
    return metrics.nearest_rank(table(spark, sf_dir, "events"), "event_type", "value", [0.1, 0.5, 0.9, 1.0])


@query(f"""
WITH b AS (SELECT CASE WHEN l_quantity >= 35 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END AS band, CAST(floor(l_discount * 100 + 0.5) AS INT)
    AS wrong FROM lineitem)
SELECT band, count(*) AS n, {_WITHIN} FROM b GROUP BY 1
""")
def band_metrics(spark, sf_dir):
    names = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    b = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.get(names, text.band(F.col("l_quantity"), [15.0, 35.0])).alias("band"),
            F.floor(F.col("l_discount") * 100 + 0.5).cast("int").alias("wrong"),
        )
    )
    return b.groupBy("band").agg(F.count("*").alias("n"), *metrics.within(F.col("wrong")))


@query("""
SELECT l_returnflag AS delivery, count(*) AS n, round(sum((l_quantity * 3 + l_discount * 100 * 15 + l_tax * 100 * 0.3e0) / 1e6 * CASE WHEN l_returnflag = 'R'
    THEN 0.5e0 ELSE 1e0 END), 6) AS cost,
sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS exact, sum(CASE WHEN l_linestatus <> 'F' AND l_tax > 0 THEN 1 ELSE 0 END)::BIGINT AS wrong,
    sum(CASE WHEN l_linestatus <> 'F' AND l_tax = 0 THEN 1 ELSE 0 END)::BIGINT AS unparseable
FROM lineitem GROUP BY 1
""")
def outcome_and_cost(spark, sf_dir):
    """Lines as answers of a model: quantities as tokens, return flag R as a batch."""
    li = table(spark, sf_dir, "lineitem")
    paid = text.cost(
        {"input": F.col("l_quantity"), "output": F.col("l_discount") * 100, "cached": F.col("l_tax") * 100},
        {"input": F.lit(3.0), "output": F.lit(15.0), "cached": F.lit(0.3)},
        F.col("l_returnflag") == "R",
    )
    done = F.col("l_linestatus") == "F"
    return li.groupBy(F.col("l_returnflag").alias("delivery")).agg(
        F.count("*").alias("n"), F.round(F.sum(paid), 6).alias("cost"), F.count_if(done).alias("exact"), F.count_if(~done & (F.col("l_tax") > 0)).alias("wrong"), F.count_if(~done & (F.col("l_tax") == 0)).alias("unparseable")
    )


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)
SELECT l_orderkey, count(*) AS answers, sum(CASE WHEN k = 1 THEN l_quantity ELSE 0 END) AS charged FROM r GROUP BY 1
""")
def charged_to_first(spark, sf_dir):
    """Several answers for one request: its usage counts once, with the first."""
    first = F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("answers"), first["l_quantity"].alias("charged"))


@query("""
SELECT event_type, median(value) AS median, min(value) AS least, max(value) AS most, coalesce(round(avg(CASE WHEN value > 1 THEN 1e0 ELSE 0e0 END), 6), 0) AS
    over_one FROM events GROUP BY 1
""")
def latency_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rest = (
        e.groupBy("event_type")
        .agg(
            F.min("value").alias("least"),
            F.max("value").alias("most"),
            F.round(F.avg((F.col("value") > 1).cast("double")), 6).alias("over_one"),
        )
    )
    return metrics.medians(e, "event_type", "value").join(rest, "event_type").select("event_type", "median", "least", "most", "over_one")


@query("""
WITH y AS (SELECT l_returnflag AS k, CASE WHEN year(l_shipdate) < 1999 THEN 'before' ELSE 'after' END AS era, l_discount FROM lineitem)
SELECT k AS returnflag, round(avg(CASE WHEN era = 'after' THEN l_discount END) - avg(CASE WHEN era = 'before' THEN l_discount END), 6) AS delta FROM y GROUP BY 1
""")
def before_after_delta(spark, sf_dir):
    y = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_returnflag").alias("returnflag"),
            F.when(F.year("l_shipdate") < 1999, "before").otherwise("after").alias("at"),
            "l_discount",
        )
    )
    wide = y.groupBy("returnflag").pivot("at", ["before", "after"]).agg(F.avg("l_discount"))
    return wide.select("returnflag", F.round(F.col("after") - F.col("before"), 6).alias("delta"))


@query("""
SELECT o_orderpriority, count(*) AS rows, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) AS BIGINT) AS scored, CAST(sum(CASE WHEN o_orderstatus =
    'O' THEN 1 ELSE 0 END) AS BIGINT) AS failures,
       round(avg(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 200000 THEN 1e0 ELSE 0e0 END WHEN o_orderstatus = 'O' THEN 0e0 END), 6) AS exact_rate
FROM orders GROUP BY 1
""")
def scoring_population(spark, sf_dir):
    """P: not attempted, left out; O: attempted without an answer, scored as a miss; F: scored."""
    status = F.col("o_orderstatus")
    exact = F.when(status == "F", (F.col("o_totalprice") > 200000).cast("double")).when(status == "O", 0.0)
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderpriority")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(status != "P").alias("scored"),
            F.count_if(status == "O").alias("failures"),
            F.round(F.avg(exact), 6).alias("exact_rate"),
        )
    )


@query("""
SELECT l_linenumber AS step, round(CASE WHEN l_linenumber < 2 THEN 0 WHEN l_linenumber < 4 THEN (l_linenumber - 1) * 0.001e0 / 2 ELSE 1e-5 + (0.001e0 - 1e-5) *
    0.5e0 * (1 + cos(least(greatest((l_linenumber - 4) / 4e0, 0), 1) * pi())) END, 9) AS rate, count(*) AS n
FROM lineitem GROUP BY 1, 2
""")
def learning_rate_by_step(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("step")).agg(F.count("*").alias("n"))
    return steps.select("step", F.round(text.learning_rate(F.col("step"), 2, 2, 8, 1e-3, 1e-5), 9).alias("rate"), "n")


@query("""
WITH d AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS epoch, round(avg(value), 6) AS acc FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY acc DESC, epoch) AS k FROM d)
SELECT user_id, epoch, acc, k AS place FROM r WHERE k <= 2
""")
def best_checkpoints(spark, sf_dir):
    """The two best days of each user by mean value, the earliest of equals first."""
    from pyspark.sql.window import Window

    d = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("epoch"))
        .agg(F.round(F.avg("value"), 6).alias("acc"))
    )
    return (
        d.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("acc"), "epoch")).cast("long"))
        .where("place <= 2")
    )


LINE_FEATURES = metrics.Features()


@LINE_FEATURES.add("quantity")
def _quantity():
    return F.col("l_quantity")


@LINE_FEATURES.add("price")
def _price():
    return F.col("l_extendedprice") / F.col("l_quantity")


@LINE_FEATURES.add("day")
def _day():
    return F.dayofmonth("l_shipdate")


def _of_feature(name: str, value: str, cuts: list[float]) -> str:
    names = metrics.band_names(len(cuts) + 1)
    place = " + ".join(f"CASE WHEN {value} >= {c} THEN 1 ELSE 0 END" for c in cuts)
    return f"SELECT '{name}' AS feature, {names}[1 + {place}] AS band, CAST({place} AS INT) AS place, wrong FROM li"


@query(f"""
WITH li AS (SELECT *, CAST(floor(l_discount * 100 + 0.5) AS INT) AS wrong FROM lineitem), q AS (SELECT l_quantity AS m FROM lineitem ORDER BY 1 LIMIT 1 OFFSET
    (SELECT count(*) // 2 FROM lineitem)),
b AS ({_of_feature("quantity", "l_quantity", ["(SELECT m FROM q)"])} UNION ALL {_of_feature("price", "l_extendedprice / l_quantity", ["1000e0", "1500e0"])}
    UNION ALL {_of_feature("day", "day(l_shipdate)", ["8", "15", "22"])} UNION ALL SELECT 'overall', NULL, NULL, wrong FROM li)
SELECT feature, band, place, count(*) AS n, {_WITHIN} FROM b GROUP BY 1, 2, 3
""")
def feature_bands(spark, sf_dir):
    """Tolerance shares by bands of three registered features in one scan; quantity is cut at its middle."""
    li = table(spark, sf_dir, "lineitem")
    cuts = {**metrics.middle_cuts(li, LINE_FEATURES, ["quantity"]), "price": [1000.0, 1500.0], "day": [8.0, 15.0, 22.0]}
    wrong = F.floor(F.col("l_discount") * 100 + 0.5).cast("int")
    return metrics.by_bands(li, LINE_FEATURES, cuts, [F.count("*").alias("n"), *metrics.within(wrong)])


@query("""
WITH s AS (SELECT vec_id, list_transform(range(0, 832), lambda j: CAST(embedding[j % 64 + 1] AS DOUBLE) * ((j // 64) % 5 + 1)) AS s FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(0, 64), lambda k: list_position(s[k * 13 + 1 : k * 13 + 13], list_max(s[k * 13 + 1 : k * 13 + 13])) - 1), ',') AS
    labels, CASE WHEN vec_id % 50 = 0 THEN 'not 832 scores' WHEN vec_id % 50 = 1 THEN 'score not finite' END AS problem FROM s WHERE vec_id % 50 > 1
UNION ALL SELECT vec_id, NULL, CASE vec_id % 50 WHEN 0 THEN 'not 832 scores' ELSE 'score not finite' END FROM s WHERE vec_id % 50 <= 1
""")
def recognized_labels(spark, sf_dir):
    """Labels of boards from 832 scores by the recognizers' hook; rows of broken scores are reported."""
    e = table(spark, sf_dir, "embeddings")
    scores = F.transform(F.sequence(F.lit(0), F.lit(831)), lambda j: F.get("embedding", j % 64).cast("double") * (F.floor(j / 64) % 5 + 1))
    broken = (
        F.when(F.col("vec_id") % 50 == 0, F.slice(scores, 1, 831))
        .when(F.col("vec_id") % 50 == 1, F.concat(F.slice(scores, 1, 831), F.array(F.lit(float("nan")))))
        .otherwise(scores)
    )
    out = recognition.recognized(e.select("vec_id", broken.alias("scores")))
    return out.select("vec_id", F.array_join("labels", ",").alias("labels"), "problem")
