"""Registered queries: centroids, assignment, neighbours and clusters of the embeddings; two-gate consensus."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import board, text
from gridloom.operators import consensus, vectors
from gridloom.plans.registry import query, table

CENTS = """
e AS (SELECT vec_id, label, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
s AS (SELECT label, i, sum(x) AS x FROM e GROUP BY 1, 2), c AS (SELECT label, i, x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-9) AS x FROM s),
sim AS (SELECT vec_id, e.label, c.label AS near, round(sum(e.x * c.x), 6) AS similarity FROM e JOIN c USING (i) GROUP BY 1, 2, 3),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, near) AS k FROM sim)
"""


@query(f"WITH {CENTS} SELECT vec_id, near, round(similarity, 4) AS similarity FROM best WHERE k = 1")
def vector_top1(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = vectors.nearest_centroid(e, vectors.centroids(e, "label"), "label")
    return out.select("vec_id", F.col("best.label").alias("near"), F.round("best.similarity", 4).alias("similarity"))


@query(f"""
WITH {CENTS} SELECT vec_id, CASE WHEN near >= 3 AND similarity >= 0.3e0 THEN 'match' WHEN near < 3 AND similarity >= 0.4e0 THEN 'absorb' ELSE 'unmatched' END AS
    outcome FROM best WHERE k = 1
""")
def vector_assign_3way(spark, sf_dir):
    """Labels below 3 count as junk; a vector without length is neither matched nor unmatched."""
    e = table(spark, sf_dir, "embeddings")
    b = F.col("best")
    outcome = (
        F.when(text.dot(F.col("embedding"), F.col("embedding")) < 1e-12, "blank")
        .when((b["label"] >= 3) & (b["similarity"] >= 0.3), "match")
        .when((b["label"] < 3) & (b["similarity"] >= 0.4), "absorb")
        .otherwise("unmatched")
    )
    return vectors.nearest_centroid(e, vectors.centroids(e, "label"), "label").select("vec_id", outcome.alias("outcome"))


@query(f"""
WITH {CENTS}, own AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS n FROM sim WHERE near = label) SELECT label, vec_id
    FROM own WHERE n = 1
""")
def cluster_representative(spark, sf_dir):
    """Of each label the vector nearest to its centroid."""
    e = table(spark, sf_dir, "embeddings")
    own = (
        e.join(vectors.centroids(e, "label"), "label")
        .select("label", "vec_id", F.round(text.dot(F.col("embedding"), F.col("centroid")), 6).alias("s"))
    )
    return (
        own.groupBy("label")
        .agg(F.max(F.struct("s", (-F.col("vec_id")).alias("m"))).alias("b"))
        .select("label", (-F.col("b.m")).alias("vec_id"))
    )


@query(f"""
WITH {CENTS} SELECT vec_id, near, round(similarity, 4) AS similarity FROM best WHERE k = 1 AND near % 4 <> 0 AND similarity >= 0.3e0
""")
def processable_matches(spark, sf_dir):
    """Nearest templates that are processable (three labels in four) and similar enough."""
    e = table(spark, sf_dir, "embeddings")
    best = vectors.nearest_centroid(e, vectors.centroids(e, "label"), "label").select("vec_id", F.col("best.label").alias("near"), F.col("best.similarity").alias("s"))
    return best.where("near % 4 <> 0 and s >= 0.3").select("vec_id", "near", F.round("s", 4).alias("similarity"))


@query("""
WITH q AS (SELECT vec_id AS a, embedding AS u FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT a, vec_id AS b, label % 2 AS y,
    round(list_dot_product(CAST(u AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS s FROM q, embeddings WHERE a <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM d)
SELECT a AS vec_id, count(*) AS neighbours, round(CASE WHEN sum(greatest(s, 0)) > 0 THEN sum(greatest(s, 0) * y) / sum(greatest(s, 0)) ELSE avg(CAST(y AS
    DOUBLE)) END, 4) AS score FROM r WHERE k <= 15 GROUP BY 1
""")
def knn_weighted_score(spark, sf_dir):
    """The rows whose id is divisible by 100 against all."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).cast("double").alias("label"))
    return vectors.neighbour_score(e.where("vec_id % 100 = 0"), e, 15)


def led_sql(start: str, most: float) -> str:
    """Greedy leaders over vectors (k from 1, id, u) one after the other, for as many ids as make one piece: led (cluster, n, c)."""
    return f"""
unit_of AS (SELECT row_number() OVER (ORDER BY id) AS k, id, list_transform(v, lambda x: x / (sqrt(list_dot_product(v, v)) + 1e-9)) AS u FROM ({start}) WHERE
    sqrt(list_dot_product(v, v)) >= 1e-6),
steps AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS DOUBLE[][]) AS sums, CAST([] AS BIGINT[]) AS counts, CAST([] AS BIGINT[]) AS firsts
    UNION ALL SELECT k, CASE WHEN near THEN list_transform(sums, lambda s, i: CASE WHEN i = best THEN list_transform(list_zip(s, u), lambda p: p[1] + p[2]) ELSE s END)
        ELSE list_append(sums, u) END, CASE WHEN near THEN list_transform(counts, lambda n, i: CASE WHEN i = best THEN n + 1 ELSE n END) ELSE list_append(counts, 1) END,
        CASE WHEN near THEN firsts ELSE list_append(firsts, id) END
    FROM (SELECT *, coalesce(1 - list_max(sims) <= {most}e0, FALSE) AS near, list_position(sims, list_max(sims)) AS best FROM (SELECT w.k, id, u, sums, counts, firsts,
        list_transform(sums, lambda s: list_dot_product(u, s) / sqrt(list_dot_product(s, s)) / sqrt(list_dot_product(u, u))) AS sims FROM steps t JOIN unit_of w ON w.k = t.k + 1))),
led AS (SELECT cluster, n, list_transform(s, lambda x: x / (sqrt(list_dot_product(s, s)) + 1e-9)) AS c FROM (SELECT unnest(firsts) AS cluster, unnest(counts) AS n, unnest(sums) AS s
    FROM steps WHERE k = (SELECT count(*) FROM unit_of)))
"""


@query(f"""
WITH RECURSIVE {led_sql("SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings", 0.7)},
met AS (SELECT vec_id, cluster, round(list_dot_product(CAST(embedding AS DOUBLE[]), c), 6) AS similarity FROM embeddings, led),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, cluster) AS n FROM met)
SELECT vec_id, cluster, round(similarity, 4) AS similarity FROM r WHERE n = 1
""")
def leader_clusters(spark, sf_dir):
    """Every vector with the nearest cluster of greedy leaders over all, and its size."""
    e = table(spark, sf_dir, "embeddings")
    led = vectors.leaders_in_turn(e, "vec_id", "embedding", 0.7)
    met = vectors.nearest_centroid(e, led.select("cluster", "centroid"), "cluster")
    # as binary numbers round: 0.66375 is less than it looks
    return met.select("vec_id", F.col("best.cluster").alias("cluster"), (F.round(F.col("best.similarity") * 10000) / 10000).alias("similarity"))


def axes_sql(n: int, squarings: int = 13) -> str:
    """The first n principal axes: columns of a high power of the covariance, which is then taken less what the axis explains."""
    out = ["""
e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
mean AS MATERIALIZED (SELECT i, avg(x) AS m FROM e GROUP BY 1), cen AS MATERIALIZED (SELECT vec_id, i, x - m AS x FROM e JOIN mean USING (i)),
cov1 AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.x * b.x) / (SELECT count(*) FROM embeddings) AS x FROM cen a JOIN cen b USING (vec_id) GROUP BY 1, 2)"""]
    for a in range(1, n + 1):
        out.append(f"p{a}_0 AS (SELECT i, j, x FROM cov{a})")
        for k in range(1, squarings + 1):
            was = f"p{a}_{k - 1}"
            out.append(
                f"p{a}_{k} AS MATERIALIZED (SELECT l.i, r.j, sum(l.x * r.x) AS x FROM (SELECT i, j, x / (SELECT max(abs(x)) FROM {was}) AS x FROM {was}) l JOIN "
                f"(SELECT i, j, x / (SELECT max(abs(x)) FROM {was}) AS x FROM {was}) r ON l.j = r.i GROUP BY 1, 2)"
            )
        last = f"p{a}_{squarings}"
        out.append(f"w{a} AS (SELECT i, x FROM {last} WHERE j = (SELECT j FROM {last} GROUP BY 1 ORDER BY sum(x * x) DESC, j LIMIT 1))")
        out.append(f"axis{a} AS MATERIALIZED (SELECT i, x / sqrt((SELECT sum(x * x) FROM w{a})) * CASE WHEN (SELECT arg_max(x, abs(x)) FROM w{a}) < 0 THEN -1 ELSE 1 END AS x FROM w{a})")
        out.append(
            f"cov{a + 1} AS MATERIALIZED (SELECT c.i, c.j, c.x - g.x * l.x * r.x AS x FROM cov{a} c JOIN axis{a} l ON l.i = c.i JOIN axis{a} r ON r.i = c.j, "
            f"(SELECT sum(c.x * l.x * r.x) AS x FROM cov{a} c JOIN axis{a} l ON l.i = c.i JOIN axis{a} r ON r.i = c.j) g)"
        )
    return ",\n".join(out)


@query(f"""
WITH {axes_sql(3)},
s AS (SELECT vec_id, sum(c.x * a.x) AS p1, sum(c.x * b.x) AS p2, sum(c.x * d.x) AS p3 FROM cen c JOIN axis1 a USING (i) JOIN axis2 b USING (i) JOIN axis3 d USING (i) GROUP BY 1)
SELECT vec_id, round(p1 / (sqrt(p1 * p1 + p2 * p2 + p3 * p3) + 1e-9), 5) AS pc1, round(p2 / (sqrt(p1 * p1 + p2 * p2 + p3 * p3) + 1e-9), 5) AS pc2,
    round(p3 / (sqrt(p1 * p1 + p2 * p2 + p3 * p3) + 1e-9), 5) AS pc3 FROM s
""")
def principal_scores(spark, sf_dir):
    """First three principal coordinates, of unit length together; the axes come from sums over all rows."""
    e = table(spark, sf_dir, "embeddings")
    mean, axes = vectors.principal_axes(e, 3)
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    centred = F.zip_with("embedding", lit(mean), lambda x, m: x - m)
    parts = (
        e.select("vec_id", F.array(*[text.dot(centred, lit(a)) for a in axes]).alias("p"))
        .select("vec_id", text.unit(F.col("p")).alias("p"))
    )
    return parts.select("vec_id", *[F.round(F.get("p", F.lit(k)), 5).alias(f"pc{k + 1}") for k in range(3)])


@query("""
WITH v AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(1, 14)) AS i FROM embeddings)), m AS (SELECT vec_id,
    max(x) AS top, ln(sum(exp(x))) AS z FROM v GROUP BY 1)
SELECT vec_id, min(i) - 1 AS label, (min(i) - 1 + 5) % 13 AS permuted, round(min(top) - min(z), 6) AS log_prob FROM v JOIN m USING (vec_id) WHERE x = top GROUP BY 1
""")
def class_of_scores(spark, sf_dir):
    """The first 13 numbers as class scores: argmax, its class in another order, its log probability."""
    s = F.transform(F.slice("embedding", 1, 13), lambda x: x.cast("double"))
    e = (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", s.alias("s"))
        .select("vec_id", board.argmax(F.col("s")).alias("label"), F.array_max(board.log_softmax(F.col("s"))).alias("log_prob"))
    )
    to = board.permuted(F.array("label"), [(k + 5) % 13 for k in range(13)])
    return e.select(
        "vec_id",
        F.col("label").cast("long").alias("label"),
        F.get(to, F.lit(0)).cast("long").alias("permuted"),
        F.round("log_prob", 6).alias("log_prob"),
    )


@query("""
WITH c AS (SELECT l_orderkey AS k, l_linenumber AS ply, l_returnflag AS placement, max(l_discount * 100) AS score, min(l_suppkey % 8) AS fit FROM lineitem GROUP
    BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY k, placement ORDER BY score DESC, ply) AS n, count(*) OVER (PARTITION BY k, placement) AS plies FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, ply, fit DESC, placement DESC) AS m, lead(score) OVER (PARTITION BY k ORDER BY score
    DESC, ply, fit DESC, placement DESC) AS rival FROM b WHERE n = 1)
SELECT k, CAST(ply AS BIGINT) AS ply, CAST(fit AS BIGINT) AS fit, round(score - rival, 6) AS margin, plies > 1 AS repetition,
CASE WHEN fit <= 4 AND coalesce(score - rival >= 2.5, TRUE) THEN 'accept' WHEN fit <= 4 OR coalesce(score - rival >= 2.5, TRUE) THEN 'review' ELSE 'quarantine'
    END AS bucket
FROM t WHERE m = 1
""")
def pair_gate(spark, sf_dir):
    """Lines as candidates of their order, return flags as placements."""
    c = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ply"), F.col("l_returnflag").alias("placement"))
        .agg(F.max(F.col("l_discount") * 100).alias("score"), F.min(F.col("l_suppkey") % 8).alias("fit"))
    )
    return (
        consensus.gate(c, "k", margin_limit=2.5)
        .select("k", F.col("ply").cast("long").alias("ply"), F.col("fit").cast("long").alias("fit"), "margin", "repetition", "bucket")
    )


@query("""
WITH e AS (SELECT vec_id, label, i - 1 AS j, CAST(embedding[i] AS DOUBLE) AS x FROM (SELECT vec_id, label, embedding, unnest(range(1, 65)) AS i FROM embeddings)),
c AS (SELECT vec_id, ply, j // 13 AS cell, CASE WHEN j // 13 = ply THEN (label + ply) % 13 ELSE label % 13 END AS want, j % 13 AS cls, x FROM e, range(3) t(ply)
    WHERE j < 52),
d AS (SELECT vec_id, cell, min(want) <> max(want) AS differs FROM c GROUP BY 1, 2), m AS (SELECT vec_id, cell, ply, any_value(want) AS want, arg_max(cls, (x,
    -cls)) AS top FROM c GROUP BY 1, 2, 3)
SELECT vec_id, m.ply, sum(CASE WHEN top <> m.want THEN 1 ELSE 0 END)::BIGINT AS fit, round(round(sum(CASE WHEN differs THEN x ELSE 0 END), 6), 4) AS score
FROM m JOIN d USING (vec_id, cell) JOIN c ON c.vec_id = m.vec_id AND c.cell = m.cell AND c.ply = m.ply AND c.cls = m.want GROUP BY 1, 2
""")
def score_window(spark, sf_dir):
    """Four cells of 13 scores each, three candidates that differ in one cell at a time."""
    e = table(spark, sf_dir, "embeddings")
    cut = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(F.slice("embedding", k * 13 + 1, 13), lambda x: x.cast("double")))
    frames = e.select("vec_id", cut.alias("log_probs"))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda k: F.when(k == F.col("ply"), (F.col("label") + F.col("ply")) % 13).otherwise(F.col("label") % 13),
    )
    candidates = e.select("vec_id", "label", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ply")).select("vec_id", "ply", cells.alias("cells"))
    return (
        consensus.score_window(frames, candidates, "vec_id")
        .select("vec_id", F.col("ply").cast("long").alias("ply"), F.col("fit").alias("fit"), F.round("score", 4).alias("score"))
    )
