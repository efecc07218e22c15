"""Registered queries: inventories, statuses, orders and enrichments."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text
from gridloom.operators import merging, nested, splits, timeline, vectors
from gridloom.plans.registry import query, table
from gridloom.plans.vectors import CENTS, led_sql


@query("""
WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'F'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT CAST(coalesce(a.k, b.k) % 100 AS BIGINT) AS stem, CASE WHEN bool_and(a.k IS NOT NULL AND b.k IS NOT NULL) THEN count(*) ELSE -1 END AS pairs FROM a FULL
    JOIN b ON a.k = b.k GROUP BY 1
""")
def paired_files(spark, sf_dir):
    """Number of pairs of each folder if every file has its partner, else -1."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "k")
    a, b = li.where("l_linestatus = 'F'").select("k").distinct().withColumn("a", F.lit(1)), li.where("l_returnflag = 'R'").select("k").distinct().withColumn("b", F.lit(1))
    both = F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull())
    return a.join(b, "k", "full").groupBy((F.col("k") % 100).alias("stem")).agg(F.when(both, F.count("*")).otherwise(F.lit(-1)).alias("pairs"))


@query("""
WITH g AS (SELECT o_custkey AS k, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT l_orderkey, l_linenumber, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON
    c_nationkey = n_nationkey WHERE l_orderkey IN (SELECT o_orderkey FROM g WHERE n = 1)
""")
def label_enrichment(spark, sf_dir):
    """Lines of the last order of each customer, with the customer and nation: later records of a key replace earlier ones."""
    o = table(spark, sf_dir, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    last = merging.last_write(o, ["o_custkey"], "at").select("o_orderkey", "o_custkey")
    c = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "c_name", "n_name")
    )
    people = last.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(people, F.col("l_orderkey") == F.col("o_orderkey"))
        .select("l_orderkey", "l_linenumber", "c_name", "n_name")
    )


@query("""
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'not_committed' WHEN quality = 0 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN n_chars < 200 THEN
    'advisory' END AS advice FROM documents LEFT JOIN labels l USING (doc_id)
""")
def outcome_status(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(1).alias("has"))
    status = F.when(F.col("has").isNull(), "not_committed").when(F.col("quality") == 0, "partial").otherwise("complete")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars")
        .join(l, "doc_id", "left")
        .select("doc_id", status.alias("status"), F.when(F.col("n_chars") < 200, "advisory").alias("advice"))
    )


@query("""
SELECT event_type, CASE WHEN x = 0 AND y = 0 THEN 'white' WHEN x / sqrt(x * x + y * y) < cos(radians(100)) THEN 'black' ELSE 'white' END AS side, count(*) AS n
FROM (SELECT event_type, value - 50 AS x, CAST(event_id % 101 AS DOUBLE) - 50 AS y FROM events) GROUP BY 1, 2
""")
def orientation(spark, sf_dir):
    """Direction as a unit vector, zero as (1, 0); Black if its cosine is below that of 100 degrees."""
    e = (
        table(spark, sf_dir, "events")
        .select("event_type", (F.col("value") - 50).alias("x"), ((F.col("event_id") % 101).cast("double") - 50).alias("y"))
    )
    length = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    cosine = F.when(length == 0, 1.0).otherwise(F.col("x") / F.nullif(length, F.lit(0.0)))
    return (
        e.groupBy("event_type", F.when(cosine < F.cos(F.radians(F.lit(100.0))), "black").otherwise("white").alias("side"))
        .agg(F.count("*").alias("n"))
    )


@query("""
SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"orderkey":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS fingerprint FROM orders
""")
def record_fingerprint(spark, sf_dir):
    """sha256 of compact JSON with sorted keys."""
    body = F.to_json(F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(body, 256).alias("fingerprint"))


@query("""
SELECT conv_id, substr(sha256(string_agg(text, '' ORDER BY turn)), 1, 16) AS digest, count(*) AS turns FROM conversations GROUP BY 1
""")
def timeline_digest(spark, sf_dir):
    """First 16 hex digits over the ordered parts of each timeline."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return t.select(
        "conv_id",
        F.substring(F.sha2(F.array_join(F.transform("t", lambda x: x["text"]), ""), 256), 1, 16).alias("digest"),
        F.size("t").cast("long").alias("turns"),
    )


@query("""
SELECT c_mktsegment, CAST(sum(CASE WHEN contains(c_name, lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0')) THEN 1 ELSE 0 END) AS BIGINT) AS surname, CAST(sum(CASE WHEN upper(regexp_replace(c_name,
    '[^A-Za-z0-9]', '', 'g')) = 'CUSTOMER' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') THEN 1 ELSE 0 END) AS BIGINT) AS exact, round(avg(CASE WHEN
    contains(c_name, lpad(CAST(c_custkey % 97 AS VARCHAR), 2, '0')) THEN 1e0 ELSE 0e0 END), 6) AS rate FROM customer GROUP BY 1
""")
def name_scores(spark, sf_dir):
    """Benchmark scores of read names: plain containment, and equality of letters and digits."""
    held = F.contains("c_name", F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"))
    exact = text.alnum_upper(F.col("c_name")) == F.concat(F.lit("CUSTOMER"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    return (
        table(spark, sf_dir, "customer")
        .groupBy("c_mktsegment")
        .agg(F.count_if(held).alias("surname"), F.count_if(exact).alias("exact"), F.round(F.avg(held.cast("double")), 6).alias("rate"))
    )


@query("""
WITH r AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey, 'tpl' || CAST(n +
    (SELECT count(*) FROM customer WHERE c_custkey % 2 = 1) AS VARCHAR) AS fresh FROM r
""")
def fresh_ids(spark, sf_dir):
    """New ids counted up from the size of the registry, in order of the keys."""
    c = table(spark, sf_dir, "customer")
    have = c.where("c_custkey % 2 = 1").count()
    new = splits.numbered(c.where("c_custkey % 2 = 0").select("c_custkey"), "c_custkey", "place")
    return new.select("c_custkey", F.concat(F.lit("tpl"), (F.col("place") + have).cast("string")).alias("fresh"))


@query("""
WITH taken AS (SELECT DISTINCT o_custkey AS t FROM orders WHERE o_custkey % 5 <> 0), have AS (SELECT count(*) AS n FROM taken), new AS (SELECT p_partkey,
    row_number() OVER (ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 0),
free AS (SELECT f, row_number() OVER (ORDER BY f) AS k FROM (SELECT unnest(range(n, n + (SELECT count(*) FROM new) + n)) AS f FROM have) WHERE f NOT IN (SELECT t FROM taken))
SELECT p_partkey, 'tpl' || CAST(f AS VARCHAR) AS fresh FROM new JOIN free USING (k)
""")
def fresh_ids_past_taken(spark, sf_dir):
    """New ids counted up from the size of the registry, past those that it has ahead of its size."""
    taken = table(spark, sf_dir, "orders").where("o_custkey % 5 <> 0").select("o_custkey").distinct()
    registry = taken.select(F.concat(F.lit("tpl"), F.col("o_custkey").cast("string")).alias("id"))
    new = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select("p_partkey")
    return splits.fresh_ids(new, "p_partkey", registry, "id", "tpl")


_PROVENANCE = """
'{"source":{"props":' || props || ',"steps":[{"file":"' || CASE WHEN event_id % 7 = 0 THEN '/srv/' ELSE 'runs/' END || event_type || '"},"/mnt/' || CAST(user_id AS STRING) || '",' ||
CASE WHEN event_id % 3 = 0 THEN '{"deep":{"er":["x","/tmp/a"]}}' ELSE 'null' END || ']},"value":' || CAST(event_id AS STRING) || '}'
"""


@query(f"""
SELECT e.event_id, replace(t.fullkey, '$', '') AS path, json_extract_string(e.j, t.fullkey) AS value FROM (SELECT event_id, {_PROVENANCE} AS j FROM events) e, json_tree(e.j) t
WHERE t.type = 'VARCHAR' AND json_extract_string(e.j, t.fullkey) LIKE '/%'
""")
def absolute_paths(spark, sf_dir):
    """Absolute texts anywhere in nested provenance: path and value of each."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_PROVENANCE).alias("provenance"))
    return nested.absolute_texts(e, ["event_id"], "provenance")


@query("""
SELECT o_orderkey, sha256('{"custkey":' || o_custkey || ',"lines":[{"a":"' || o_orderstatus || '","b":{"x":null,"y":' || (o_orderkey % 7) || '}},true],"price":' ||
    regexp_replace(CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR), '[.]?0+$', '') || '}') AS fingerprint FROM orders
""")
def canonical_fingerprint(spark, sf_dir):
    """sha256 of the canonical JSON of nested records; the members are written in another order here."""
    o = F.col("o_orderkey")
    inner = F.struct((o % 7).alias("y"), F.lit(None).cast("int").alias("x"))
    line = F.to_json(F.struct(inner.alias("b"), F.col("o_orderstatus").alias("a")), {"ignoreNullFields": "false"})
    record = F.concat(F.lit('{"price": '), F.col("o_totalprice").cast("string"), F.lit(', "lines": [ '), line, F.lit(' ,true], "custkey":'), F.col("o_custkey").cast("string"), F.lit("}"))
    return table(spark, sf_dir, "orders").select(o, record.alias("r")).select("o_orderkey", F.sha2(nested.canonical(F.col("r")), 256).alias("fingerprint"))


@query("""
SELECT l_shipmode AS kind, n FROM (SELECT CASE WHEN l_quantity < 10 THEN 'unknown' WHEN l_returnflag = 'A' THEN 'gap' ELSE 'task' END AS l_shipmode, count(*) AS
    n FROM lineitem WHERE NOT (l_quantity >= 10 AND l_returnflag = 'N') GROUP BY 1)
""")
def triage(spark, sf_dir):
    """No match: unknown; junk (flag N) dropped; board only (flag A): counted as a gap; else a task."""
    li = table(spark, sf_dir, "lineitem").where("not (l_quantity >= 10 and l_returnflag = 'N')")
    return (
        li.groupBy(F.when(F.col("l_quantity") < 10, "unknown").when(F.col("l_returnflag") == "A", "gap").otherwise("task").alias("kind"))
        .agg(F.count("*").alias("n"))
    )


@query("""
WITH w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1 ELSE 0 END, value DESC, event_id) AS
    place FROM events) SELECT * FROM w WHERE place <= 3
""")
def worst_first(spark, sf_dir):
    """A top-3 report: the greatest values of each user first, errors last, ids on a tie."""
    w = Window.partitionBy("user_id").orderBy(F.when(F.col("event_type") == "error", 1).otherwise(0), F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("place")).where("place <= 3")


@query("""
WITH f AS (SELECT source, doc_id // 10000 AS part, doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), g AS (SELECT source,
    part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, count(*) AS n FROM f GROUP BY 1, 2)
SELECT source, part, coalesce(n, 0) AS n, coalesce(sha256(ids), '') AS ids_sha256 FROM (SELECT DISTINCT source FROM documents) LEFT JOIN g USING (source)
""")
def sets_by_source(spark, sf_dir):
    """Ids flagged in each source by ranges of 10,000 ids, so no list is longer; a source without any has one empty row."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    flagged = d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    held = (
        flagged.groupBy("source", F.floor(F.col("doc_id") / 10000).alias("part"))
        .agg(F.array_sort(F.collect_set("doc_id")).alias("ids"), F.count("*").alias("n"))
    )
    return (
        d.select("source")
        .distinct()
        .join(held, "source", "left")
        .select(
            "source",
            "part",
            F.coalesce("n", F.lit(0)).cast("long").alias("n"),
            F.coalesce(F.sha2(F.array_join("ids", ","), 256), F.lit("")).alias("ids_sha256"),
        )
    )


@query("""
WITH p AS (SELECT DISTINCT user_id FROM events WHERE value > 300) SELECT event_type, count(*) AS n FROM events WHERE user_id NOT IN (SELECT user_id FROM p) GROUP BY 1
""")
def reviewed_gate(spark, sf_dir):
    """Whole users are left out while any of their rows is pending."""
    e = table(spark, sf_dir, "events")
    return (
        e.join(e.where("value > 300").select("user_id").distinct(), "user_id", "left_anti")
        .groupBy("event_type")
        .agg(F.count("*").alias("n"))
    )


@query("""
SELECT o_orderkey, o_orderstatus = 'O' OR n IS NULL OR n < 2 AS again FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus =
    'F' GROUP BY 1) ON l_orderkey = o_orderkey
""")
def rerun_predicate(spark, sf_dir):
    """Missing, not attempted, or failed and to be retried."""
    n = (
        table(spark, sf_dir, "lineitem")
        .where("l_linestatus = 'F'")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("n"))
    )
    again = (F.col("o_orderstatus") == "O") | F.col("n").isNull() | (F.col("n") < 2)
    return table(spark, sf_dir, "orders").join(n, "o_orderkey", "left").select("o_orderkey", again.alias("again"))


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY
    user_id) AS n FROM events) WHERE k IN (1, n, 1 + (n - 1) // 2)
""")
def spread_order(spark, sf_dir):
    """The ends and the middle of each user's values: the first three of the spread order."""
    w = Window.partitionBy("user_id")
    e = (
        table(spark, sf_dir, "events")
        .select("user_id", "event_id", F.row_number().over(w.orderBy("value", "event_id")).alias("k"), F.count("*").over(w).alias("n"))
    )
    return e.where((F.col("k") == 1) | (F.col("k") == F.col("n")) | (F.col("k") == 1 + F.floor((F.col("n") - 1) / 2))).select("user_id", "event_id")


@query(f"""
WITH RECURSIVE {CENTS}, out AS (SELECT vec_id, CASE WHEN near >= 3 AND similarity >= 0.3e0 THEN 'match' WHEN near < 3 AND similarity >= 0.4e0 THEN 'absorb' ELSE
    'unmatched' END AS outcome FROM best WHERE k = 1),
{led_sql("SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings JOIN out USING (vec_id) WHERE outcome = 'unmatched'", 0.8)},
cent AS (SELECT label, list(x ORDER BY i) AS w FROM c GROUP BY 1),
met AS (SELECT cluster, n, round(max(round(list_dot_product(led.c, w), 6)), 4) AS similarity FROM led, cent GROUP BY 1, 2),
t AS (SELECT outcome, count(*) AS n FROM out GROUP BY 1)
SELECT 'tally' AS kind, outcome AS name, CAST(n - CASE WHEN outcome = 'unmatched' THEN coalesce((SELECT sum(n) FROM met WHERE similarity >= 0.5e0), 0) ELSE 0 END AS BIGINT) AS n,
    CAST(NULL AS DOUBLE) AS similarity FROM t
UNION ALL SELECT 'cluster', CAST(cluster AS VARCHAR), n, similarity FROM met WHERE similarity < 0.5e0
""")
def suppressed_clusters(spark, sf_dir):
    """Tallies of the assignment of all vectors, and clusters of all unmatched ones together.

    A cluster whose mean lies at a known centroid is left out, and its vectors are taken off the tally of the unmatched.
    """
    e = table(spark, sf_dir, "embeddings")
    known = vectors.centroids(e, "label")
    b = F.col("best")
    outcome = (
        F.when((b["label"] >= 3) & (b["similarity"] >= 0.3), "match")
        .when((b["label"] < 3) & (b["similarity"] >= 0.4), "absorb")
        .otherwise("unmatched")
    )
    named = vectors.nearest_centroid(e, known, "label").withColumn("outcome", outcome).drop("best")
    led = vectors.leaders_in_turn(named.where("outcome = 'unmatched'"), "vec_id", "embedding", 0.8)
    met = (
        vectors.nearest_centroid(led.withColumnRenamed("centroid", "embedding"), known, "label")
        .withColumn("similarity", F.round(F.col("best.similarity") * 10000) / 10000)  # as binary numbers round
    )
    gone = met.where("similarity >= 0.5").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("gone"))
    tallies = named.groupBy("outcome").agg(F.count("*").alias("n")).join(F.broadcast(gone))
    left = tallies.select(
        F.lit("tally").alias("kind"),
        F.col("outcome").alias("name"),
        F.when(F.col("outcome") == "unmatched", F.col("n") - F.col("gone")).otherwise(F.col("n")).alias("n"),
        F.lit(None).cast("double").alias("similarity"),
    )
    return left.union(met.where("similarity < 0.5").select(F.lit("cluster"), F.col("cluster").cast("string"), "n", "similarity"))


@query("""
WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events), a AS (SELECT user_id, sec, event_id AS a FROM e WHERE event_type = 'click'), b AS
    (SELECT user_id, sec, event_id AS b FROM e WHERE event_type = 'view')
SELECT a, b, b.sec - a.sec AS gap FROM a JOIN b USING (user_id) WHERE b.sec BETWEEN a.sec - 1800 AND a.sec + 1800
""")
def clock_range_join(spark, sf_dir):
    """Views within half an hour of a click of the same user, by buckets of an hour."""
    e = table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    a = (
        e.where("event_type = 'click'")
        .select(
            "user_id",
            F.col("event_id").alias("a"),
            F.col("sec").alias("at"),
            (F.col("sec") - 1800).alias("low"),
            (F.col("sec") + 1800).alias("high"),
        )
    )
    b = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("b"), "sec")
    return timeline.range_join(b, a, ["user_id"], "sec", "low", "high", 3600).select("a", "b", (F.col("sec") - F.col("at")).alias("gap"))
