"""Registered queries: reviews, queues, releases and reports over them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import text
from gridloom.operators import quality, review, timeline
from gridloom.plans.registry import query, table

DECIDED = """
d AS (SELECT o_orderkey AS k, o_orderstatus, o_custkey % 10 AS c, o_totalprice > 400000 AS dup FROM orders),
a AS (SELECT k, dup, CASE c WHEN 0 THEN 'reject' WHEN 1 THEN 'correct' WHEN 2 THEN 'accept' WHEN 3 THEN 'accept' END AS decision FROM d)
"""


@query(f"""
WITH {DECIDED} SELECT o_orderkey, round(CASE WHEN decision = 'correct' THEN o_totalprice + 1 ELSE o_totalprice END, 2) AS price, coalesce(decision IN ('accept',
    'correct'), FALSE) OR o_orderstatus = 'F' AS verified FROM orders JOIN a ON k = o_orderkey WHERE coalesce(decision, '') <> 'reject'
""")
def reviews_applied(spark, sf_dir):
    """Rejected orders go, corrected ones are replaced, accepted and formerly verified ones count as verified."""
    o = table(spark, sf_dir, "orders")
    c = F.col("o_custkey") % 10
    rows = o.select("o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_orderstatus") == "F").alias("verified"))
    decision = F.when(c == 0, "reject").when(c == 1, "correct").when((c == 2) | (c == 3), "accept")
    decided = o.select("o_orderkey", decision.alias("decision")).where("decision is not null")
    fixes = o.where(c == 1).select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"))
    return review.applied(rows, decided, fixes, "o_orderkey", ["price"]).select("o_orderkey", F.round("price", 2).alias("price"), "verified")


@query("""
WITH g AS (SELECT l_orderkey AS k, max(l_linenumber) AS n, min(l_discount) AS m FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1)
SELECT o_orderkey, CASE WHEN k IS NULL THEN 'review' WHEN n <= 4 AND m >= 0.02e0 THEN 'accept' WHEN n <= 4 OR m >= 0.02e0 THEN 'review' ELSE 'quarantine' END AS
    bucket, CASE WHEN k IS NULL THEN -1 ELSE CAST(n AS BIGINT) END AS fit, m AS margin FROM orders LEFT JOIN g ON k = o_orderkey
""")
def missing_timeline(spark, sf_dir):
    """A candidate whose timeline is missing goes to review, with fit -1 and no margin."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .where("l_orderkey % 3 <> 0")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.max("l_linenumber").cast("long").alias("fit"), F.min("l_discount").alias("margin"))
    )
    return review.bucketed(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", 4, 0.02)


@query(f"""
WITH {DECIDED} SELECT k AS o_orderkey, CASE WHEN dup THEN 'reject' WHEN o_orderstatus = 'F' THEN 'accept' WHEN o_orderstatus = 'P' THEN 'undecided' ELSE
    'reject' END AS decision FROM d
""")
def seeded_decisions(spark, sf_dir):
    """First decisions: duplicates are rejected before the bucket is looked at."""
    o = F.col("o_orderstatus")
    bucket = F.when(o == "F", "accept").when(o == "P", "review").otherwise("quarantine")
    return table(spark, sf_dir, "orders").select("o_orderkey", review.seeded(F.col("o_totalprice") > 400000, bucket).alias("decision"))


@query("""
SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1) AS verified FROM orders WHERE o_orderstatus <> 'P'
""")
def preseeded_file(spark, sf_dir):
    """Candidates again, those verified before marked, all others pending."""
    seen = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"))
    return review.preseeded(table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select("o_orderkey"), seen, "o_orderkey")


@query("""
WITH old AS (SELECT doc_id, source, n_chars AS v FROM documents WHERE doc_id % 5 <> 0), fresh AS (SELECT doc_id, source, n_chars + 1 AS v FROM documents WHERE
    source IN ('src1', 'src3') AND doc_id % 3 <> 0)
SELECT doc_id, source, v, 'kept' AS change FROM old WHERE source NOT IN ('src1', 'src3') UNION ALL SELECT doc_id, source, v, 'built' FROM fresh
UNION ALL SELECT doc_id, source, v, 'dropped' FROM old WHERE source IN ('src1', 'src3') AND doc_id NOT IN (SELECT doc_id FROM fresh)
""")
def scoped_rebuild(spark, sf_dir):
    """Two sources are built anew, the others stay; rows of the old table that the new one lacks are reported."""
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 5 <> 0").select("doc_id", "source", F.col("n_chars").alias("v"))
    fresh = d.where("source in ('src1', 'src3') and doc_id % 3 <> 0").select("doc_id", "source", (F.col("n_chars") + 1).alias("v"))
    return review.rebuilt(old, fresh, F.col("source").isin("src1", "src3"), "doc_id")


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem), b AS (SELECT o_orderkey, count(l_orderkey) AS answers, sum(CASE WHEN
    l_returnflag = 'N' THEN 1 ELSE 0 END) AS errors FROM orders LEFT JOIN r ON l_orderkey = o_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN answers = 0 THEN 'pending' WHEN errors = answers THEN 'failed' ELSE 'done' END AS state FROM b
""")
def batch_states(spark, sf_dir):
    """A request of a batch is pending without an answer, failed with errors alone, else done."""
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "N").alias("error"))
    return review.batch_state(table(spark, sf_dir, "orders").select("o_orderkey"), answers, "o_orderkey", "error")


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'P' AS started FROM orders WHERE o_orderstatus <> 'F') SELECT o_custkey, o_orderkey, row_number() OVER
    (PARTITION BY o_custkey ORDER BY NOT started, o_orderkey) AS place, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY NOT started, o_orderkey) AS
    following FROM s
""")
def resumable_first(spark, sf_dir):
    """The queue of open reviews: begun ones first, then by id, each with the one after it."""
    w = Window.partitionBy("o_custkey").orderBy(~F.col("started"), "o_orderkey")
    s = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").withColumn("started", F.col("o_orderstatus") == "P")
    return s.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("place"), F.lead("o_orderkey").over(w).alias("following"))


@query("""
SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END, l_linenumber, l_partkey,
    l_suppkey, l_quantity) AS place FROM lineitem
""")
def pending_first(spark, sf_dir):
    """Lines in their order, the open ones before the others."""
    w = (
        Window.partitionBy("l_orderkey")
        .orderBy(F.when(F.col("l_linestatus") == "O", 0).otherwise(1), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT r_name, string_agg(n_name, ',' ORDER BY n_nationkey) AS categories FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def categories_by_id(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        n.groupBy("r_name")
        .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("c"))
        .select("r_name", F.array_join(F.transform("c", lambda c: c["n_name"]), ",").alias("categories"))
    )


@query("""
WITH v AS (SELECT vec_id, label, round(1 / (1 + exp(-8 * CAST(embedding[1] AS DOUBLE))), 4) AS p FROM embeddings) SELECT vec_id, label, p, row_number() OVER
    (PARTITION BY label ORDER BY p DESC, vec_id) AS place, p >= 0.5e0 AS likely FROM v
""")
def board_first(spark, sf_dir):
    """Clusters by their likelihood, rounded to four places, the likeliest first and in order of ids on a tie."""
    p = F.round(1 / (1 + F.exp(-8 * F.get("embedding", F.lit(0)).cast("double"))), 4)
    w = Window.partitionBy("label").orderBy(F.desc("p"), "vec_id")
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "label", p.alias("p"))
        .select("vec_id", "label", "p", F.row_number().over(w).cast("long").alias("place"), (F.col("p") >= 0.5).alias("likely"))
    )


@query("""
WITH d AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, round(avg(value), 6) AS sq, count(*) AS board FROM events GROUP BY 1, 2),
s AS (SELECT user_id, sq, board, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS step FROM d),
b AS (SELECT *, max((sq, board)) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, before IS NULL OR (sq, board) > before AS better FROM b), l AS (SELECT *, max(CASE WHEN better THEN step END) OVER (PARTITION BY user_id ORDER
    BY step) AS best FROM i),
e AS (SELECT user_id, min(step) AS stop FROM l WHERE step - best >= 3 GROUP BY 1)
SELECT l.user_id, max(l.best) AS best_step, max(l.step) AS last_step, bool_or(stop IS NOT NULL) AS stopped_early FROM l LEFT JOIN e ON e.user_id = l.user_id
    WHERE stop IS NULL OR l.step <= stop GROUP BY 1
""")
def patience_stop(spark, sf_dir):
    """Days as steps: a run ends at the third in a row that isn't better than the best so far; mean, then count, is the score."""
    d = (
        table(spark, sf_dir, "events")
        .groupBy("user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).alias("day"))
        .agg(F.round(F.avg("value"), 6).alias("sq"), F.count("*").alias("board"))
    )
    s = d.withColumn("step", (F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1).cast("long"))
    return review.patient(s, "user_id", "step", ["sq", "board"], 3)


@query("""
SELECT CASE WHEN page_id % 4 = 0 THEN 'p' || page_id WHEN page_id % 3 = 0 THEN 'h' || (page_id % 50) ELSE 'v' || (page_id % 20) END AS unit, count(*) AS n FROM
    pages GROUP BY 1
""")
def grouping_unit(spark, sf_dir):
    """The game of a page, or else its video, or else its own name."""
    p = F.col("page_id")
    game = F.when((p % 4 != 0) & (p % 3 == 0), F.concat(F.lit("h"), (p % 50).cast("string")))
    video = F.when(p % 4 != 0, F.concat(F.lit("v"), (p % 20).cast("string")))
    unit = review.grouping_unit("game", game, video, F.concat(F.lit("p"), p.cast("string")))
    return table(spark, sf_dir, "pages").groupBy(unit.alias("unit")).agg(F.count("*").alias("n"))


@query("""
SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING bool_or(quality = 1) AND bool_or(quality = 0)
""")
def adaptation_targets(spark, sf_dir):
    """Sources that have both splits: good labels for training, bad ones for validation."""
    l = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "train").otherwise("val").alias("split"))
    return review.with_splits(table(spark, sf_dir, "documents").select("doc_id", "source").join(l, "doc_id"), "source", "split", ["train", "val"])


@query("""
WITH s AS (SELECT l_partkey AS k, 'a' AS part FROM lineitem WHERE l_returnflag = 'A' AND l_linenumber = 1 UNION ALL SELECT l_partkey, 'b' FROM lineitem WHERE
    l_returnflag = 'R' AND l_linenumber = 2 UNION ALL SELECT l_suppkey + 1000000000, 'c' FROM lineitem),
d AS (SELECT DISTINCT * FROM s) SELECT x.part AS one, y.part AS other, count(*) AS shared FROM d x JOIN d y ON x.k = y.k AND x.part < y.part GROUP BY 1, 2
""")
def pairwise_disjoint(spark, sf_dir):
    """Pairs of three sets that share keys, and how many."""
    li = table(spark, sf_dir, "lineitem")
    a, b = li.where("l_returnflag = 'A' and l_linenumber = 1").select(F.col("l_partkey").alias("k")), li.where("l_returnflag = 'R' and l_linenumber = 2").select(F.col("l_partkey").alias("k"))
    return quality.overlaps({"a": a, "b": b, "c": li.select((F.col("l_suppkey") + 1000000000).alias("k"))}, "k")


@query("""
WITH c AS (SELECT n_name AS name, 1 AS part FROM nation UNION ALL SELECT r_name, 2 FROM region UNION ALL SELECT n_name, 3 FROM nation WHERE n_regionkey = 1)
    SELECT name, count(*) AS n, min(part) AS first_part FROM c GROUP BY 1
""")
def concatenated(spark, sf_dir):
    """Several sets one after the other; what is in two of them is there twice."""
    n = table(spark, sf_dir, "nation")
    parts = [n.select(F.col("n_name").alias("name"), F.lit(1).alias("part")), table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit(2).alias("part")), n.where("n_regionkey = 1").select(F.col("n_name").alias("name"), F.lit(3).alias("part"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("name").agg(F.count("*").alias("n"), F.min("part").alias("first_part"))


@query("""
WITH f AS (SELECT l_orderkey AS k, l_returnflag AS split, l_partkey AS part FROM lineitem WHERE l_linenumber <= 2),
i AS (SELECT 'repeated id' AS issue, CAST(k AS VARCHAR) AS what FROM f GROUP BY k HAVING count(*) > 1 UNION ALL SELECT 'group in several splits', CAST(part AS
    VARCHAR) FROM f GROUP BY part HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'no such order', CAST(k AS VARCHAR) FROM (SELECT DISTINCT k FROM f) WHERE k NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT
    'order without a line', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM f)
UNION ALL SELECT 'count of split', split || ' ' || count(*) FROM f GROUP BY split HAVING count(*) <> 1000)
SELECT issue, what FROM i
""")
def structural_issues(spark, sf_dir):
    """Every structural issue of a dataset in one list, as text."""
    f = (
        table(spark, sf_dir, "lineitem")
        .where("l_linenumber <= 2")
        .select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("split"), F.col("l_partkey").alias("part"))
    )
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    sizes = (
        f.groupBy("split")
        .agg(F.count("*").alias("n"))
        .where("n <> 1000")
        .select(F.concat_ws(" ", "split", F.col("n").cast("string")).alias("what"))
    )
    return quality.issues(
        {
            "repeated id": quality.duplicates(f, "k").select("k"),
            "group in several splits": quality.straddling(f, "part", "split").select("part"),
            "no such order": f.select("k").distinct().join(o, "k", "left_anti"),
            "order without a line": o.join(f, "k", "left_anti"),
            "count of split": sizes,
        }
    )


@query("""
WITH r AS (SELECT event_id AS i, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'twice' ELSE 's' || event_id END AS given, event_id % 83 = 0 AS bare, user_id,
    event_type FROM events),
s AS (SELECT i, given, CASE WHEN bare THEN NULL WHEN i % 79 = 0 THEN '/tmp/s' || i || '.jpg' ELSE 'images/s' || i || '.jpg' END AS image, CASE WHEN i % 71 = 0 THEN NULL
    WHEN event_type = 'error' THEN 'other' WHEN event_type = 'view' THEN 'train' WHEN event_type = 'click' THEN 'val' ELSE 'test' END AS split, CASE WHEN i % 73 = 0 THEN ''
    ELSE 'g' || CAST(user_id * 1000 + i // 200 AS VARCHAR) END AS game FROM r),
m AS (SELECT *, coalesce(given, regexp_extract(image, '([^/]+?)([.][^./]*)?$', 1)) AS id FROM s), w(split, want) AS (VALUES ('train', 100), ('val', 200), ('test', 300)),
f AS (SELECT 'images/s' || event_id || '.jpg' AS image FROM events WHERE event_id % 67 <> 0)
SELECT 'no sample identity' AS issue, CAST(i AS VARCHAR) AS what FROM m WHERE id IS NULL UNION ALL SELECT 'no image path', CAST(i AS VARCHAR) FROM m WHERE image IS NULL
UNION ALL SELECT 'other image path', i || ' ' || image FROM m WHERE image IS NOT NULL AND image IS DISTINCT FROM 'images/' || id || '.jpg'
UNION ALL SELECT 'invalid split', concat_ws(' ', i, split) FROM m WHERE split IS NULL OR split = 'other' UNION ALL SELECT 'no game', CAST(i AS VARCHAR) FROM m WHERE game = ''
UNION ALL SELECT 'repeated id', id FROM m WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'repeated image', image FROM m WHERE image IS NOT NULL
    GROUP BY image HAVING count(*) > 1
UNION ALL SELECT 'game in several splits', game FROM m WHERE game <> '' AND split <> 'other' GROUP BY game HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'count of split', coalesce(split, 'none') || ' ' || n FROM (SELECT split, count(*) AS n FROM m GROUP BY 1) LEFT JOIN w USING (split) WHERE n IS DISTINCT FROM want
UNION ALL SELECT 'missing image', image FROM m WHERE image LIKE 'images/%' AND image NOT IN (SELECT image FROM f)
UNION ALL SELECT 'partial', 'the manifest says so itself'
""")
def manifest_issues(spark, sf_dir):
    """Events as records of a manifest with every kind of fault that the structural checks look for."""
    i = F.col("event_id")
    name = F.concat(F.lit("s"), i.cast("string"))
    e = table(spark, sf_dir, "events").select(
        i.alias("index"),
        F.when(i % 97 == 0, None).when(i % 89 == 0, "twice").otherwise(name).alias("sample_id"),
        F.when(i % 83 == 0, None).when(i % 79 == 0, F.concat(F.lit("/tmp/"), name, F.lit(".jpg"))).otherwise(F.concat(F.lit("images/"), name, F.lit(".jpg"))).alias("image"),
        F.when(i % 71 == 0, None).when(F.col("event_type") == "error", "other").when(F.col("event_type") == "view", "train").when(F.col("event_type") == "click", "val").otherwise("test").alias("split"),
        F.when(i % 73 == 0, "").otherwise(F.concat(F.lit("g"), (F.col("user_id") * 1000 + F.floor(i / 200)).cast("string"))).alias("game_id"),
    )
    there = table(spark, sf_dir, "events").where(i % 67 != 0).select(F.concat(F.lit("images/"), name, F.lit(".jpg")).alias("image"))
    return quality.manifest_issues(e, {"train": 100, "val": 200, "test": 300}, there, partial=True)


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS grp, l_orderkey % 40 AS video FROM lineitem WHERE l_linenumber = 1) SELECT (SELECT count(DISTINCT video) FROM p) AS
    videos, (SELECT count(DISTINCT grp) FROM p) AS groups, (SELECT count(*) FROM p) AS pairs, (SELECT count(*) FROM (SELECT grp FROM p GROUP BY 1 HAVING
    count(*) > 1)) AS cross_video
""")
def manifest_counts(spark, sf_dir):
    """Videos, groups, groups within videos, and groups that several videos share."""
    p = (
        table(spark, sf_dir, "lineitem")
        .where("l_linenumber = 1")
        .select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") % 40).alias("video"))
    )
    return quality.manifest_counts(p, "video", "grp")


@query("""
WITH g AS (SELECT l_linestatus AS model, count(*) AS n, sum((l_quantity * 3 + l_discount * 1500) / 1e6 * CASE WHEN l_returnflag = 'R' THEN 0.5e0 ELSE 1e0 END)
    AS spent FROM lineitem GROUP BY 1)
SELECT model, n, round(spent, 6) AS spent, round(spent / n, 9) AS per_image, round(spent / n * (SELECT count(*) FROM part), 6) AS projected FROM g
""")
def cost_projection(spark, sf_dir):
    """What a model's answers cost each, and would for all parts; return flag R has the price of a batch."""
    paid = text.cost(
        {"input": F.col("l_quantity"), "output": F.col("l_discount") * 100, "cached": F.lit(0.0)},
        {"input": F.lit(3.0), "output": F.lit(15.0), "cached": F.lit(0.0)},
        F.col("l_returnflag") == "R",
    )
    total = table(spark, sf_dir, "part").agg(F.count("*").alias("total"))
    g = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_linestatus").alias("model"))
        .agg(F.count("*").alias("n"), F.sum(paid).alias("spent"))
    )
    return (
        g.join(F.broadcast(total))
        .select(
            "model",
            "n",
            F.round("spent", 6).alias("spent"),
            F.round(F.col("spent") / F.col("n"), 9).alias("per_image"),
            F.round(F.col("spent") / F.col("n") * F.col("total"), 6).alias("projected"),
        )
    )


@query("""
WITH v AS (SELECT user_id, event_type AS view, event_id, CASE WHEN event_id % 6 = 0 THEN -1 ELSE value END AS sharp FROM events), r AS (SELECT *, row_number()
    OVER (PARTITION BY user_id, view ORDER BY sharp DESC, event_id) AS k FROM v)
SELECT user_id, view, event_id, sharp FROM r WHERE k = 1
""")
def sharpest_view(spark, sf_dir):
    """The sharpest picture of each view, the first of equals; one that can't be read counts as -1."""
    v = (
        table(spark, sf_dir, "events")
        .select("user_id", F.col("event_type").alias("view"), "event_id", F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("seen"))
    )
    return review.sharpest(v, ["user_id", "view"], "seen", "event_id").select("user_id", "view", "event_id", F.col("seen").alias("sharp"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id)
    AS n FROM events),
d AS (SELECT user_id, event_id, i, n, CAST(0 AS BIGINT) AS lo, n - 1 AS hi, 0 AS depth FROM e WHERE i > 0 AND i < n - 1
UNION ALL SELECT user_id, event_id, i, n, CASE WHEN i > (lo + hi) // 2 THEN (lo + hi) // 2 ELSE lo END, CASE WHEN i < (lo + hi) // 2 THEN (lo + hi) // 2 ELSE hi
    END, depth + 1 FROM d WHERE i <> (lo + hi) // 2),
m AS (SELECT user_id, event_id, i, max(depth) AS depth FROM d GROUP BY 1, 2, 3), a AS (SELECT user_id, event_id, i, depth FROM m UNION ALL SELECT user_id,
    event_id, i, -1 FROM e WHERE i = 0 OR i = n - 1)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY depth, i) AS place FROM a
""")
def spread_places(spark, sf_dir):
    """Every event's place in the spread order of its user's values: the ends, then the middles, breadth first."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return timeline.spread(e, ["user_id"], ["value", "event_id"]).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("""
SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND text IS NOT NULL AND text <>
    '' GROUP BY 1
""")
def readable_truth(spark, sf_dir):
    """Only what has a truth that can be read counts."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return (
        table(spark, sf_dir, "documents")
        .where("text is not null and text <> ''")
        .select("doc_id", "lang", "n_chars")
        .join(good, "doc_id")
        .groupBy("lang")
        .agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    )


@query("""
SELECT doc_id, n_chars > 300 AS boxed FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 300 AND (quality IS NULL OR quality <> 1)
""")
def boxed_ungraded(spark, sf_dir):
    """Rows with a box drawn that have no good grade."""
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").where("n_chars > 300").select("doc_id").join(l, "doc_id", "left")
    return d.where(~F.coalesce(F.col("quality") == 1, F.lit(False))).select("doc_id", F.lit(True).alias("boxed"))


@query("""
WITH l AS (SELECT p_partkey, p_size % 4 <> 0 AS board, p_size % 3 <> 0 AS clock, p_size % 5 <> 0 AS plates FROM part)
SELECT CASE WHEN NOT board THEN 'requires curation' WHEN clock AND plates THEN 'processable' ELSE 'board only' END AS layout, count(*) AS n FROM l GROUP BY 1
""")
def layouts(spark, sf_dir):
    """Layouts by the rectangles that they have."""
    size = F.col("p_size")
    rect = lambda there: F.when(there, F.struct(F.lit(0).alias("x"), F.lit(0).alias("y")))
    return (
        table(spark, sf_dir, "part")
        .groupBy(review.layout(rect(size % 4 != 0), rect(size % 3 != 0), rect(size % 5 != 0)).alias("layout"))
        .agg(F.count("*").alias("n"))
    )


@query("""
WITH r AS (SELECT l_shipdate, l_returnflag, CASE WHEN l_returnflag = 'N' THEN 'first' ELSE 'second' END AS engine, l_linestatus = 'O' AS white, l_discount >
    0.03e0 AS black, l_tax AS secs FROM lineitem)
SELECT engine, count(*) AS n, round(avg(CASE WHEN white THEN 1e0 ELSE 0e0 END), 6) AS white, round(avg(CASE WHEN black THEN 1e0 ELSE 0e0 END), 6) AS black,
    round(avg(CASE WHEN white AND black THEN 1e0 ELSE 0e0 END), 6) AS pair, round(avg(secs), 6) AS secs FROM r GROUP BY 1
UNION ALL SELECT 'third', 0, 0, 0, 0, 0
""")
def engine_scores(spark, sf_dir):
    """Shares of names read, of pairs read, and mean seconds of each engine; one without rows scores 0."""
    li = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.when(F.col("l_returnflag") == "N", "first").otherwise("second").alias("engine"),
            (F.col("l_linestatus") == "O").alias("white"),
            (F.col("l_discount") > 0.03).alias("black"),
            F.col("l_tax").alias("secs"),
        )
    )
    return review.engine_scores(li, ["first", "second", "third"])


@query("""
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS turns, length(text) AS size
    FROM conversations
""")
def rows_of_group(spark, sf_dir):
    """The rows of each group in order, handed back with their places."""
    c = (
        table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", F.char_length("text").cast("long").alias("size")))).alias("r"))
    )
    return (
        c.select("conv_id", F.size("r").cast("long").alias("turns"), F.posexplode("r").alias("place", "x"))
        .select("conv_id", "x.turn", F.col("place").cast("long").alias("place"), "turns", "x.size")
    )


@query("""
WITH n AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 2 = 0), h AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
    SELECT n.k, h.k IS NULL AS inserted FROM n LEFT JOIN h ON n.k = h.k
""")
def insert_report(spark, sf_dir):
    """Of rows to insert where their key is absent, which ones were."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return review.inserted(c.where("k % 2 = 0"), c.where("k % 3 = 0"), "k")


@query("""
SELECT CASE WHEN p.k IS NULL THEN 'missing' WHEN t.k IS NULL THEN 'unexpected' ELSE 'paired' END AS status, count(*) AS n, CAST(sum(CASE WHEN p.s = t.s THEN 1
    ELSE 0 END) AS BIGINT) AS equal
FROM (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 9 <> 0) p FULL JOIN (SELECT l_orderkey AS k, max(l_linestatus) AS s FROM
    lineitem GROUP BY 1) t ON p.k = t.k GROUP BY 1
""")
def predictions_and_truth(spark, sf_dir):
    """Predictions joined to truths by id; ids of one side alone are counted, not lost."""
    p = (
        table(spark, sf_dir, "orders")
        .where("o_orderkey % 9 <> 0")
        .select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("p"))
    )
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("t"))
    return review.paired(p, t, "k").groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("p") == F.col("t")).alias("equal"))


@query("""
WITH c AS (SELECT source, count(*) AS found, sum(CASE WHEN text IS NULL OR text = '' THEN 1 ELSE 0 END) AS empty FROM documents GROUP BY 1), l AS (SELECT
    source, count(*) AS labelled FROM documents JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, found, CAST(empty AS BIGINT) AS empty, coalesce(labelled, 0) AS labelled, coalesce(labelled, 0) = found AND empty = 0 AS strict FROM c LEFT JOIN
    l USING (source)
""")
def strict_inventory(spark, sf_dir):
    """Whether every document of a source is there and has its label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.col("text") == "", F.lit(True)).alias("empty"))
    l = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    c = (
        d.join(l, "doc_id", "left")
        .groupBy("source")
        .agg(F.count("*").alias("found"), F.count_if("empty").alias("empty"), F.count("l").alias("labelled"))
    )
    return c.withColumn("strict", (F.col("labelled") == F.col("found")) & (F.col("empty") == 0))
