"""Registered queries: checks of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import quality
from gridloom.plans.registry import query, table


@query("""
SELECT 'part' AS kind, l_partkey AS grp, count(DISTINCT l_returnflag) AS splits FROM lineitem GROUP BY 2 HAVING count(DISTINCT l_returnflag) > 1
UNION ALL SELECT 'customer', o_custkey, count(DISTINCT o_orderstatus) FROM orders GROUP BY 2 HAVING count(DISTINCT o_orderstatus) > 1
""")
def straddling_groups(spark, sf_dir):
    a = (
        quality.straddling(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")
        .select(F.lit("part").alias("kind"), F.col("l_partkey").alias("grp"), "splits")
    )
    return a.union(
        quality.straddling(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus").select(F.lit("customer"), "o_custkey", "splits"),
    )


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dups(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return d.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""
WITH t AS (SELECT DISTINCT sha256(text) AS h FROM documents WHERE source IN ('src0', 'src1', 'src2'))
SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src1', 'src2') AND sha256(text) IN (SELECT h FROM t)
""")
def leakage_overlap(spark, sf_dir):
    """Documents outside three test sources whose content is in them too."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    test = F.col("source").isin("src0", "src1", "src2")
    return d.where(~test).join(d.where(test).select("h"), "h", "left_semi").select("doc_id", "source")


@query("""
SELECT source, count(*) AS expected, count(l.doc_id) AS available, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS missing, sum(CASE WHEN l.doc_id
    IS NULL THEN 1 ELSE 0 END) > 0 AS partial
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1
""")
def completeness_report(spark, sf_dir):
    return quality.completeness(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", "source")


@query("""
WITH a AS (SELECT o_orderkey, o_totalprice AS v FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN
    o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 17 <> 0)
SELECT o_orderkey, CASE WHEN b.v IS NULL THEN 'missing' WHEN a.v IS NULL THEN 'unexpected' ELSE 'changed' END AS status FROM a FULL JOIN b USING (o_orderkey)
    WHERE a.v IS NULL OR b.v IS NULL OR a.v <> b.v
""")
def checksum_diff(spark, sf_dir):
    """Orders against a copy with rows left out and changed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    copy = o.where("o_orderkey % 17 <> 0").withColumn("v", F.when(F.col("o_orderkey") % 13 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return quality.difference(o.where("o_orderkey % 11 <> 0"), copy, "o_orderkey", "v")


@query("""
SELECT o_orderkey, r AS rule FROM (
SELECT o_orderkey, unnest([CASE WHEN NOT o_totalprice > 10000 THEN 'price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END, CASE WHEN NOT
    regexp_matches(o_orderpriority, '^[1-5]-') OR o_orderpriority = '5-LOW' THEN 'priority' END]) AS r FROM orders) WHERE r IS NOT NULL
""")
def record_violations(spark, sf_dir):
    rules = {"price": F.col("o_totalprice") > 10000, "status": F.col("o_orderstatus").isin("F", "O"), "priority": F.col("o_orderpriority").rlike("^[1-5]-") & (F.col("o_orderpriority") != "5-LOW")}
    return quality.violations(table(spark, sf_dir, "orders"), "o_orderkey", rules)


@query("""
SELECT 'orphan lines' AS name, count(*) AS failures, count(*) = 0 AS passed FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'unlabelled documents', count(*), count(*) = 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'repeated ids', count(*), count(*) = 0 FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'nations without region', count(*), count(*) = 0 FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
""")
def audit_checks(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    return quality.audit(
        spark,
        {
            "orphan lines": t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
            "unlabelled documents": t("documents").select("doc_id").join(t("labels"), "doc_id", "left_anti"),
            "repeated ids": quality.duplicates(t("documents"), "doc_id"),
            "nations without region": t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left_anti"),
        },
    )


@query("""
SELECT lang, count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT n_chars) AS sizes, count(DISTINCT source) < 2 AS thin FROM documents GROUP BY 1
""")
def diversity(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .groupBy("lang")
        .agg(
            F.count("*").alias("documents"),
            F.count_distinct("source").alias("sources"),
            F.count_distinct("n_chars").alias("sizes"),
            (F.count_distinct("source") < 2).alias("thin"),
        )
    )


@query("""
SELECT CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS kind, count(*) AS available, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS
    unlabelled, bool_and(l.doc_id IS NOT NULL) AS complete,
       CASE WHEN bool_and(l.doc_id IS NOT NULL) THEN 'comparable' ELSE 'partial' END AS status
FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY 1
""")
def comparability(spark, sf_dir):
    d = (
        table(spark, sf_dir, "documents")
        .select("doc_id", "n_chars")
        .join(table(spark, sf_dir, "labels").withColumn("has", F.lit(True)), "doc_id", "left")
    )
    complete = F.bool_and(F.col("has").isNotNull())
    return (
        d.groupBy(F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("kind"))
        .agg(
            F.count("*").alias("available"),
            F.count_if(F.col("has").isNull()).alias("unlabelled"),
            complete.alias("complete"),
            F.when(complete, "comparable").otherwise("partial").alias("status"),
        )
    )


@query("""
WITH m AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 0), f AS (SELECT l_orderkey AS k, max(l_linestatus) AS s, count(*) AS
    n FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1)
SELECT coalesce(m.k, f.k) AS k, CASE WHEN f.k IS NULL THEN 'no file' WHEN m.k IS NULL THEN 'no record' WHEN n > 6 THEN 'repeated' ELSE 'differs' END AS problem
FROM m FULL JOIN f ON m.k = f.k WHERE f.k IS NULL OR m.k IS NULL OR n > 6 OR m.s <> f.s
""")
def strict_one_to_one(spark, sf_dir):
    """Records and files must meet one to one, with equal fields."""
    m = (
        table(spark, sf_dir, "orders")
        .where("o_orderkey % 5 <> 0")
        .select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("a"), F.lit(1).alias("m"))
    )
    f = (
        table(spark, sf_dir, "lineitem")
        .where("l_orderkey % 7 <> 0")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(F.max("l_linestatus").alias("b"), F.count("*").alias("n"))
    )
    problem = (
        F.when(F.col("n").isNull(), "no file")
        .when(F.col("m").isNull(), "no record")
        .when(F.col("n") > 6, "repeated")
        .when(F.col("a") != F.col("b"), "differs")
    )
    return m.join(f, "k", "full").select("k", problem.alias("problem")).where("problem is not null")


@query("""
SELECT CASE WHEN regexp_matches(path, '^images/[^/]+$') THEN 'safe' ELSE 'unsafe' END AS verdict, count(*) AS n FROM (SELECT CASE WHEN page_id % 3 = 0 THEN
    'images/' ELSE '/images/' END || CAST(page_id AS VARCHAR) || '.png' AS path FROM pages) GROUP BY 1
""")
def path_safety(spark, sf_dir):
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "images/").otherwise("/images/"), F.col("page_id").cast("string"), F.lit(".png"))
    return (
        table(spark, sf_dir, "pages")
        .groupBy(F.when(text.safe_path(path), "safe").otherwise("unsafe").alias("verdict"))
        .agg(F.count("*").alias("n"))
    )


@query("""
WITH p AS (SELECT doc_id FROM documents WHERE n_chars > 500), l AS (SELECT doc_id FROM labels)
SELECT 'left' AS side, doc_id FROM p WHERE doc_id NOT IN (SELECT doc_id FROM l) UNION ALL SELECT 'right', doc_id FROM l WHERE doc_id NOT IN (SELECT doc_id FROM p)
""")
def symmetric_difference(spark, sf_dir):
    p, l = table(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id", F.lit(1).alias("p")), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    return (
        p.join(l, "doc_id", "full")
        .where("p is null or l is null")
        .select(F.when(F.col("l").isNull(), "left").otherwise("right").alias("side"), "doc_id")
    )
