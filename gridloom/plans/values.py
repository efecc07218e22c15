"""Registered queries: values of records checked, completed and mapped."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import values
from gridloom.plans.registry import query, table


@query("""
SELECT l_orderkey, string_agg(l_returnflag || l_linenumber, ' ' ORDER BY l_extendedprice, l_linenumber, l_returnflag) AS tokens FROM lineitem GROUP BY 1
""")
def token_order(spark, sf_dir):
    """Lines as detections on the picture of their order, prices as places: tokens from left to right."""
    token = F.concat("l_returnflag", F.col("l_linenumber").cast("string"))
    found = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.collect_list(
                F.struct(
                    F.col("l_extendedprice").alias("x"),
                    F.col("l_linenumber").alias("n"),
                    F.col("l_returnflag").alias("f"),
                    token.alias("token"),
                ),
            )
            .alias("found"),
        )
    )
    return found.select("l_orderkey", F.array_join(values.left_to_right(F.col("found")), " ").alias("tokens"))


@query("""
WITH e AS (SELECT vec_id, list_transform(range(1, 65), lambda i: CAST(floor(CAST(embedding[i] AS DOUBLE) * 40) AS INT) + 6) AS labels, CAST(embedding[1] AS
    DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings),
d AS (SELECT vec_id, labels, CASE WHEN vec_id % 3 = 0 THEN a ELSE a / sqrt(a * a + b * b) END AS x, CASE WHEN vec_id % 3 = 0 THEN b ELSE b / sqrt(a * a + b * b)
    END AS y FROM e)
SELECT vec_id, len(labels) = 64 AND list_min(labels) >= 0 AND list_max(labels) <= 12 AS labels_ok, abs(x) <= 1 AND abs(y) <= 1 AND abs(sqrt(x * x + y * y) - 1)
    <= 0.0001e0 AS direction_ok FROM d
""")
def prediction_invariants(spark, sf_dir):
    """64 classes of 0 to 12, and a direction of unit length; a third of the directions is left as it is."""
    a, b = F.get("embedding", F.lit(0)).cast("double"), F.get("embedding", F.lit(1)).cast("double")
    size = F.when(F.col("vec_id") % 3 == 0, 1.0).otherwise(F.sqrt(a * a + b * b))
    labels = F.transform("embedding", lambda x: F.floor(x.cast("double") * 40).cast("int") + 6)
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            "vec_id",
            values.labels_ok(labels).alias("labels_ok"),
            values.direction_ok(F.array(a / size, b / size)).alias("direction_ok"),
        )
    )


@query("""
WITH c AS (SELECT vec_id % 13 AS label FROM embeddings) SELECT CASE WHEN label = 0 THEN 0 ELSE (label - 1) % 6 + 1 END AS type, CASE WHEN label = 0 THEN 0 WHEN
    label <= 6 THEN 1 ELSE 2 END AS colour, count(*) AS n FROM c GROUP BY 1, 2
""")
def aux_targets(spark, sf_dir):
    """Classes as seven types and three colours, by a join with the table of classes."""
    c = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % 13).alias("label")).agg(F.count("*").alias("n"))
    return c.join(F.broadcast(values.classes(spark)), "label").groupBy("type", "colour").agg(F.sum("n").alias("n"))


@query("""
WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'native' WHEN p_partkey % 5 = 1 THEN CAST(p_size AS VARCHAR) WHEN p_partkey % 5 = 2 THEN '-' ||
    p_size WHEN p_partkey % 5 = 3 THEN CAST(p_size - p_size AS VARCHAR) ELSE p_name END AS spec FROM part)
SELECT p_partkey, spec = 'native' OR (regexp_matches(spec, '^[0-9]+$') AND TRY_CAST(spec AS BIGINT) > 0) AS valid, CASE WHEN regexp_matches(spec, '^[0-9]+$')
    AND TRY_CAST(spec AS BIGINT) > 0 THEN TRY_CAST(spec AS BIGINT) END AS size FROM s
""")
def size_spec(spark, sf_dir):
    """Sizes as written: native, positive, negative, zero, or a name."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    spec = F.when(k == 0, "native").when(k == 1, size).when(k == 2, F.concat(F.lit("-"), size)).when(k == 3, "0").otherwise(F.col("p_name"))
    valid, square = values.size_spec(spec)
    return table(spark, sf_dir, "part").select("p_partkey", valid.alias("valid"), square.alias("size"))


@query("""
WITH r AS (SELECT o_orderkey, CAST(o_custkey % 40 AS BIGINT) - 5 AS x, CAST(o_orderkey % 30 AS BIGINT) - 3 AS y, CAST(o_orderkey % 50 AS BIGINT) AS w,
    CAST(o_custkey % 35 AS BIGINT) - 1 AS h FROM orders)
SELECT o_orderkey, w > 0 AND h > 0 AND x >= 0 AND y >= 0 AS valid, greatest(x, 0) AS cx, greatest(y, 0) AS cy, greatest(least(x + w, 60) - greatest(x, 0), 0) AS
    cw, greatest(least(y + h, 40) - greatest(y, 0), 0) AS ch FROM r
""")
def rect_check(spark, sf_dir):
    """Rectangles with positive size and an origin that isn't negative, and their part inside a frame of 60 by 40."""
    o = (
        table(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            F.struct(
                (F.col("o_custkey") % 40 - 5).alias("x"),
                (F.col("o_orderkey") % 30 - 3).alias("y"),
                (F.col("o_orderkey") % 50).alias("w"),
                (F.col("o_custkey") % 35 - 1).alias("h"),
            )
            .alias("r"),
        )
    )
    cut = values.clipped(F.col("r"), 60, 40)
    return o.select("o_orderkey", values.rect_ok(F.col("r")).alias("valid"), *[cut[k].alias(f"c{k}") for k in "xywh"])


@query("""
SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END, 4) AS fit, coalesce(CASE WHEN
    event_id % 5 = 0 THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) / 8 END, 5) AS margin FROM events
""")
def defaulted_thresholds(spark, sf_dir):
    """Thresholds that the record of a run names, or else the module's own."""
    k = F.from_json("props", "map<string,string>")["k"].cast("double")
    given = F.map_filter(
        F.create_map(F.lit("fit"), F.when(F.col("event_id") % 3 != 0, k), F.lit("margin"), F.when(F.col("event_id") % 5 == 0, k / 8)),
        lambda _,
        v: v.isNotNull(),
    )
    return (
        table(spark, sf_dir, "events")
        .select("event_id", *[c.alias(n) for n, c in values.thresholds(given, {"fit": 4.0, "margin": 5.0}).items()])
    )


@query("""
SELECT event_id, '{"kind":"' || event_type || '"' || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"check":{"k":' || json_extract_string(props, '$.k') || '}' END || '}' AS record FROM events WHERE event_type IN ('click', 'view')
UNION ALL SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '{}' ELSE '{"check":{"k":' || json_extract_string(props, '$.k') || '}}' END FROM events WHERE event_type NOT IN ('click', 'view')
""")
def struct_round_trip(spark, sf_dir):
    """Records read by their schema and written again: unknown keys go, names outside a list are null, the inner record may be missing."""
    inner = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.concat(F.lit(', "check": '), "props"))
    text = F.concat(F.lit('{"odd": [1, 2], "kind": "'), "event_type", F.lit('"'), inner, F.lit(', "more": {"x": 1}}'))
    return (
        table(spark, sf_dir, "events")
        .select("event_id", values.round_trip(text, "kind string, check struct<k:int>", {"kind": ["click", "view"]}).alias("record"))
    )


@query("""
WITH s AS (SELECT source, count(l.doc_id) > 2 AS has FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1)
SELECT source, wanted, CASE WHEN has THEN wanted IS NOT NULL AND wanted IN ('train', 'val') ELSE wanted IS NULL END AS valid FROM s, (VALUES ('train'),
    ('other'), (NULL)) t(wanted)
""")
def split_required(spark, sf_dir):
    """A dataset with splits wants one of them, one without wants none."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    has = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "source")
        .join(l, "doc_id", "left")
        .groupBy("source")
        .agg((F.count("l") > 2).alias("has"))
    )
    asked = has.select("source", "has", F.explode(F.array(F.lit("train"), F.lit("other"), F.lit(None).cast("string"))).alias("wanted"))
    return asked.select(
        "source",
        "wanted",
        values.split_fits(
            F.when(F.col("has"), F.array(F.lit("train"), F.lit("val"))).otherwise(F.array().cast("array<string>")),
            F.col("wanted"),
        )
        .alias("valid"),
    )


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'mp4' WHEN 4 THEN 'bmp' END AS kind FROM pages
""")
def media_sniff(spark, sf_dir):
    """Contents with the first bytes of five kinds of media, and the pages' own text, which is none."""
    from gridloom.functions import text

    heads = F.array(*[F.unhex(F.lit(h)) for h in ("89504E470D0A1A0A", "FFD8FFE0", "474946383961", "00000018667479706D703432", "424D")])
    body = F.concat(
        F.coalesce(F.get(heads, (F.col("page_id") % 6).cast("int")), F.lit("").cast("binary")),
        F.encode(F.substring("html", 1, 64), "UTF-8"),
    )
    return table(spark, sf_dir, "pages").select("page_id", text.media_kind(body).alias("kind"))
