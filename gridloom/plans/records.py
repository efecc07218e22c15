"""Registered queries: text columns, joins of records, merges, reviews and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text
from gridloom.operators import matching, merging, metrics, review, splits
from gridloom.plans.registry import query, table


@query(r"""
SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') AS page, CASE WHEN contains(url,
    '?') THEN url || '&t=' ELSE url || '?t=' END || CAST(page_id AS VARCHAR) || 's' AS link FROM pages
""")
def url_parse(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    page = F.nullif(F.regexp_extract("url", "[?&]page=([0-9]+)", 1), F.lit(""))
    return p.select(
        "page_id",
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
        page.alias("page"),
        text.seek_link(F.col("url"), F.col("page_id") + 0.7).alias("link"),
    )


@query(r"""
SELECT c_custkey, lower(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE CASE WHEN length(c_name) > length(c_mktsegment) THEN c_name ELSE c_mktsegment END
    END) AS surname FROM customer
""")
def surname_key(spark, sf_dir):
    name = (
        F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(", ", "c_mktsegment", "c_name"))
        .otherwise(F.concat_ws(" ", "c_mktsegment", "c_name"))
    )
    return table(spark, sf_dir, "customer").select("c_custkey", text.surname_key(name).alias("surname"))


@query("""
WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS name FROM part), t AS (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS tok FROM part),
m AS (SELECT p_partkey, name, bool_or(contains(p_name, name)) OR bool_or(CASE WHEN least(length(tok), length(name)) < 4 THEN tok = name ELSE (contains(tok,
    name) OR contains(name, tok)) AND abs(length(tok) - length(name)) <= 2 END) AS hit FROM t, w GROUP BY 1, 2)
SELECT name, count(*) AS parts FROM m WHERE hit GROUP BY 1
""")
def fuzzy_name(spark, sf_dir):
    """Last words of part names read in all part names; both lists are the distinct names, not the rows."""
    p = table(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"))
    names = p.select(F.split("p_name", " ")[1].alias("name")).distinct()
    return matching.names_in(names, "name", p, "p_name").join(p, "p_name").groupBy("name").agg(F.sum("n").alias("parts"))


@query(r"""
SELECT p_partkey, upper(regexp_replace(p_brand || '-' || p_name, '[^A-Za-z0-9]', '', 'g')) AS alnum, replace(trim(p_name), ' ', '') AS squeezed,
    regexp_matches(p_brand, '^[A-Za-z0-9_-]{1,64}$') AS id_ok, p_type || '_all' AS slug FROM part
""")
def text_normalizers(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        text.alnum_upper(F.concat_ws("-", "p_brand", "p_name")).alias("alnum"),
        text.squeezed(F.col("p_name")).alias("squeezed"),
        text.custom_id(F.col("p_brand")).alias("id_ok"),
        text.slug(F.col("p_type"), F.lit(None).cast("string")).alias("slug"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, '' AS bad FROM orders")
def compact_date(spark, sf_dir):
    compact = F.date_format("o_orderdate", "yyyyMMdd")
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", text.dashed_date(compact).alias("day"), text.dashed_date(F.concat(F.lit("x"), compact)).alias("bad"))
    )


@query("""
SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2
""")
def json_props_project(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "value", (F.from_json("props", "k bigint")["k"] % 10).alias("k"))
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, role, length(text) AS n FROM r WHERE k = 1
""")
def last_write_wins(spark, sf_dir):
    last = merging.last_write(table(spark, sf_dir, "conversations"), ["conv_id"], "turn")
    return last.select("conv_id", "turn", "role", F.char_length("text").cast("long").alias("n"))


@query("""
SELECT source, count(*) AS unlabelled, min(doc_id) AS first_doc FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1
""")
def anti_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return d.groupBy("source").agg(F.count("*").alias("unlabelled"), F.min("doc_id").alias("first_doc"))


@query("""
WITH o AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, -c_nationkey AS v FROM customer WHERE
    c_custkey % 2 = 0)
SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT k, v FROM n
""")
def upsert_by_key(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old, new = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey as k", "c_nationkey as v"), c.where("c_custkey % 2 = 0").selectExpr("c_custkey as k", "-c_nationkey as v")
    return merging.upsert(old, new, ["k"])


@query("""
WITH old AS (SELECT user_id, event_type, event_id, event_id % 50 AS frame FROM events WHERE event_id % 2 = 0), fresh AS (SELECT user_id, event_type, event_id,
    event_id % 50 AS frame FROM events WHERE event_id % 5 = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, frame ORDER BY event_id) AS k FROM old o WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.user_id =
    o.user_id AND f.event_type = o.event_type))
SELECT user_id, event_type, event_id FROM l WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.user_id = l.user_id AND f.frame = l.frame)
""")
def salvage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (F.col("event_id") % 50).alias("frame"))
    return (
        merging.salvage(
            e.where("event_id % 2 = 0"),
            e.where("event_id % 5 = 1"),
            ["user_id", "event_type"],
            ["user_id", "frame"],
            "event_id",
        )
        .select("user_id", "event_type", "event_id")
    )


@query("""
SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'undecided' WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'correct' ELSE 'accept' END AS decision FROM
    documents LEFT JOIN labels l USING (doc_id)
""")
def resume_decisions(spark, sf_dir):
    l = table(spark, sf_dir, "labels").withColumn("seen", F.lit(True))
    decision = (
        F.when(F.col("seen").isNull(), "undecided")
        .when(F.col("toxic") == 1, "reject")
        .when(F.col("quality") == 0, "correct")
        .otherwise("accept")
    )
    return table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", decision.alias("decision"))


@query("""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'dropped' ELSE 'kept' END AS change FROM o FULL JOIN n ON o.k = n.k
""")
def set_changes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "k")
    return merging.set_changes(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "k")


@query("""
WITH s AS (SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS o, max(CASE WHEN
    o_orderstatus = 'P' THEN 1 ELSE 0 END) AS p, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT *, CASE WHEN n < 3 THEN 'added' WHEN p = 1 AND o = 1 AND f = 1 THEN 'mixed' WHEN p = 1 THEN 'review' WHEN o = 1 THEN 'produced' ELSE 'shipped' END
    AS stage FROM s)
SELECT stage, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders, round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM t GROUP BY 1
""")
def stage_dashboard(spark, sf_dir):
    has = lambda s: F.max((F.col("o_orderstatus") == s).cast("int")) == 1
    s = (
        table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(has("F").alias("f"), has("O").alias("o"), has("P").alias("p"), F.count("*").alias("n"))
    )
    stage = (
        F.when(F.col("n") < 3, "added")
        .when(F.col("p") & F.col("o") & F.col("f"), "mixed")
        .when(F.col("p"), "review")
        .when(F.col("o"), "produced")
        .otherwise("shipped")
    )
    t = s.groupBy(stage.alias("stage")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))
    return t.withColumn("percent", F.round(100.0 * F.col("customers") / F.sum("customers").over(Window.partitionBy(F.lit(1))), 4))


@query("""
SELECT action, n FROM (
  SELECT 1 AS place, 'label documents' AS action, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 2, 'review toxic', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 3, 'fix quality', count(*) FROM labels WHERE quality = 0 UNION ALL
    SELECT 4, 'close conversations', count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING max(turn) < 1)) WHERE n > 0
""")
def pending_actions(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    found = [
        ("label documents", table(spark, sf_dir, "documents").select("doc_id").join(l, "doc_id", "left_anti")),
        ("review toxic", l.where("toxic = 1")),
        ("fix quality", l.where("quality = 0")),
        ("close conversations", table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("t")).where("t < 1")),
    ]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("action"), "n") for name, df in found]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("n > 0")


@query("""
SELECT o_orderkey, CASE WHEN n IS NULL THEN 'missing game' WHEN n < l THEN 'out of range' WHEN bad THEN 'mismatch' ELSE 'ok' END AS problem, s AS state
FROM (SELECT o_orderkey, CAST(o_orderkey % 7 + 1 AS BIGINT) AS l FROM orders) o LEFT JOIN (SELECT l_orderkey AS k, CAST(max(l_linenumber) AS BIGINT) AS n FROM
    lineitem GROUP BY 1) g ON k = o_orderkey
LEFT JOIN (SELECT l_orderkey AS k2, l_linenumber AS p, min(l_linestatus) AS s, min(l_linestatus) <> 'F' AS bad FROM lineitem GROUP BY 1, 2) t ON k2 = o_orderkey AND p = l
""")
def claimed_place(spark, sf_dir):
    """Each order claims one line number: no lines, beyond the last, not as claimed, or fine."""
    li = table(spark, sf_dir, "lineitem")
    games = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("n"))
    places = (
        li.groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("l"))
        .agg(F.min("l_linestatus").alias("state"))
    )
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).alias("l"))
    problem = (
        F.when(F.col("n").isNull(), "missing game")
        .when(F.col("n") < F.col("l"), "out of range")
        .when(F.col("state") != "F", "mismatch")
        .otherwise("ok")
    )
    return (
        o.join(games, "o_orderkey", "left")
        .join(places, ["o_orderkey", "l"], "left")
        .select("o_orderkey", problem.alias("problem"), "state")
    )


@query("""
WITH p AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ply, row_number() OVER (PARTITION BY user_id
    ORDER BY ts, event_id) - 1 + event_id % 3 - 1 AS want FROM events)
SELECT a.event_id, a.want AS ply, round(coalesce(b.value, a.value), 4) AS value, b.event_id IS NOT NULL AS moved FROM p a LEFT JOIN p b ON b.user_id = a.user_id
    AND b.ply = a.want
""")
def repointed(spark, sf_dir):
    """Rows pointed at the place before, at or after their own take that place's value if there is one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.row_number().over(w) - 1).cast("long").alias("ply"))
    to = p.select("user_id", F.col("ply").alias("want"), F.col("value").alias("there"))
    return (
        p.withColumn("want", F.col("ply") + F.col("event_id") % 3 - 1)
        .join(to, ["user_id", "want"], "left")
        .select(
            "event_id",
            F.col("want").alias("ply"),
            F.round(F.coalesce("there", "value"), 4).alias("value"),
            F.col("there").isNotNull().alias("moved"),
        )
    )


@query("""
SELECT n_name, r_name, count(c_custkey) AS customers, coalesce(round(sum(c_acctbal), 2), 0) AS balance FROM nation JOIN region ON n_regionkey = r_regionkey LEFT
    JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 0 GROUP BY 1, 2
""")
def every_key_kept(spark, sf_dir):
    """Pieces joined to categories and boards: every board stays, with no piece too."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = (
        table(spark, sf_dir, "customer")
        .where("c_acctbal > 0")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.count("*").alias("k"), F.sum("c_acctbal").alias("s"))
    )
    return (
        n.join(c, "n_nationkey", "left")
        .select(
            "n_name",
            "r_name",
            F.coalesce("k", F.lit(0).cast("long")).alias("customers"),
            F.coalesce(F.round("s", 2), F.lit(0.0)).alias("balance"),
        )
    )


@query("""
WITH v AS (SELECT o_orderkey AS video, CASE WHEN o_orderkey % 2 = 0 THEN [o_orderkey % 25] ELSE NULL END AS rounds, CAST(o_custkey % 5 AS INT) AS region FROM orders)
SELECT video, n_nationkey AS round FROM v JOIN nation ON CASE WHEN rounds IS NULL THEN n_regionkey = region ELSE n_nationkey = rounds[1] END
""")
def rounds_of_videos(spark, sf_dir):
    """Explicit ids, or else all ids of the group; a video without either would end the job."""
    rounds = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("tournament"), F.col("n_nationkey").cast("long").alias("round"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video"), "o_custkey")
    own = F.when(F.col("video") % 2 == 0, F.array(F.col("video") % 25))
    entries = o.select("video", own.alias("round_ids"), F.array((F.col("o_custkey") % 5).cast("int")).alias("tournaments"))
    return review.rounds_of(o, entries, rounds)


@query("""
WITH b AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'review' WHEN 'F' THEN 'accept' ELSE 'quarantine' END AS bucket, o_totalprice > 400000 AS dup,
    o_custkey % 10 AS shift FROM orders)
SELECT bucket, count(*) AS n, CAST(sum(CASE WHEN dup THEN 1 ELSE 0 END) AS BIGINT) AS duplicates, CAST(sum(CASE WHEN shift <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS
    shifted, CAST(sum(CASE WHEN bucket = 'review' AND NOT dup THEN 1 ELSE 0 END) AS BIGINT) AS pending FROM b GROUP BY 1
""")
def bucket_tallies(spark, sf_dir):
    bucket = F.when(F.col("o_orderstatus") == "P", "review").when(F.col("o_orderstatus") == "F", "accept").otherwise("quarantine")
    dup = F.col("o_totalprice") > 400000
    return (
        table(spark, sf_dir, "orders")
        .withColumn("bucket", bucket)
        .groupBy("bucket")
        .agg(
            F.count("*").alias("n"),
            F.count_if(dup).alias("duplicates"),
            F.count_if(F.col("o_custkey") % 10 != 0).alias("shifted"),
            F.count_if((F.col("bucket") == "review") & ~dup).alias("pending"),
        )
    )


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END, o_orderdate,
    o_orderkey) AS place FROM orders
""")
def review_order(spark, sf_dir):
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    w = Window.partitionBy("o_custkey").orderBy(rank, "o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("""
SELECT l_suppkey, CAST(round_even(median(l_quantity), 0) AS BIGINT) AS x, CAST(round_even(median(l_extendedprice), 0) AS BIGINT) AS y FROM lineitem GROUP BY 1
""")
def default_rect(spark, sf_dir):
    """Median of each coordinate, rounded half to even."""
    m = metrics.medians_of(table(spark, sf_dir, "lineitem"), "l_suppkey", {"x": "l_quantity", "y": "l_extendedprice"})
    return m.select("l_suppkey", F.bround("x", 0).cast("long").alias("x"), F.bround("y", 0).cast("long").alias("y"))


@query("""
WITH f AS (SELECT doc_id, md5(coalesce(text, '')) AS fp FROM documents), c AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'stale' ELSE md5(coalesce(text, ''))
    END AS fp FROM documents WHERE doc_id % 4 <> 0)
SELECT f.doc_id, CASE WHEN c.fp IS NULL THEN 'new' WHEN c.fp <> f.fp THEN 'changed' ELSE 'reuse' END AS work FROM f LEFT JOIN c USING (doc_id)
""")
def reuse_by_fingerprint(spark, sf_dir):
    f = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("fp"))
    cached = f.where("doc_id % 4 <> 0").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "stale").otherwise(F.col("fp")).alias("had"))
    return (
        f.join(cached, "doc_id", "left")
        .select(
            "doc_id",
            F.when(F.col("had").isNull(), "new").when(F.col("had") != F.col("fp"), "changed").otherwise("reuse").alias("work"),
        )
    )


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) SELECT o_custkey, CAST((k + 4) // 5 AS
    BIGINT) AS batch, count(*) AS n, min(o_orderkey) AS first_order FROM r GROUP BY 1, 2
""")
def batch_chunks(spark, sf_dir):
    """Requests in batches of five for each customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    r = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.ceil(F.row_number().over(w) / 5).alias("batch"))
    return r.groupBy("o_custkey", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_order"))


@query("""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR) || '-7'), doc_id) AS k FROM
    documents) WHERE k <= 5
""")
def support_sample(spark, sf_dir):
    """Five documents of each language in a seeded order: a sampling operator."""
    w = Window.partitionBy("lang").orderBy(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("-7")), 256), "doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.row_number().over(w).alias("k")).where("k <= 5").drop("k")


@query("""
WITH RECURSIVE d AS (SELECT doc_id, source || '/' || lang AS grp FROM documents), v AS (SELECT grp, count(*) AS n FROM d WHERE doc_id % 997 = 0 GROUP BY 1),
f AS (SELECT grp, row_number() OVER (ORDER BY count(*), sha256(grp || '-7'), grp) AS k FROM d WHERE grp NOT IN (SELECT grp FROM v) GROUP BY 1), h AS (SELECT
    count(*) AS h FROM v),
t(k, a, b, c, split) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), h, CAST(0 AS BIGINT), '' FROM h UNION ALL
SELECT k + 1, a + CAST(x >= y AND x >= z AS INT), b + CAST(y > x AND y >= z AS INT), c + CAST(z > x AND z > y AS INT), CASE WHEN x >= y AND x >= z THEN 'train'
    WHEN y >= z THEN 'val' ELSE 'test' END
FROM (SELECT *, 60 * (a + b + c + 1) - 100 * a AS x, 20 * (a + b + c + 1) - 100 * b AS y, 20 * (a + b + c + 1) - 100 * c AS z FROM t WHERE k < (SELECT count(*)
    FROM f)))
SELECT doc_id, d.grp, CASE WHEN v.grp IS NOT NULL THEN 'val' ELSE split END AS split FROM d LEFT JOIN v USING (grp) LEFT JOIN f USING (grp) LEFT JOIN t ON t.k = f.k
""")
def split_plan(spark, sf_dir):
    """Documents of one source and language stay together; some ids are assigned before."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang").alias("grp"))
    given = d.where("doc_id % 997 = 0").select("doc_id", F.lit("val").alias("split"))
    return splits.plan(d, "grp", "doc_id", 7, existing=given)


@query("""
SELECT o_orderkey, CASE WHEN margin IS NULL OR margin >= 2 THEN 'green' WHEN margin >= 1 THEN 'yellow' ELSE 'red' END AS margin_colour, CASE WHEN fit <= 0 THEN
    'green' WHEN fit <= 2 THEN 'yellow' ELSE 'red' END AS fit_colour
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice / 100000 END AS margin, o_custkey % 4 AS fit FROM orders)
""")
def colour_codes(spark, sf_dir):
    o = (
        table(spark, sf_dir, "orders")
        .select(
            "o_orderkey",
            F.when(F.col("o_orderkey") % 5 == 0, None).otherwise(F.col("o_totalprice") / 100000).alias("margin"),
            (F.col("o_custkey") % 4).alias("fit"),
        )
    )
    code = lambda good, fair: F.when(good, "green").when(fair, "yellow").otherwise("red")
    return o.select(
        "o_orderkey",
        code(F.col("margin").isNull() | (F.col("margin") >= 2), F.col("margin") >= 1).alias("margin_colour"),
        code(F.col("fit") <= 0, F.col("fit") <= 2).alias("fit_colour"),
    )
