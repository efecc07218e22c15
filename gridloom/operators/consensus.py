"""Two-gate consensus: score candidates where they differ, then accept, review or quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT, MARGIN = 4, 5.0


def score_window(frames: DataFrame, candidates: DataFrame, on: str) -> DataFrame:
    """frames (on, log_probs[64][13]) against candidates (on, ply, cells): fit and score of each.

    fit: cells where the most likely class isn't the candidate's. score: sum of the candidate's log
    probabilities over the cells on which the candidates of the frame differ.
    """
    cells = candidates.select(on, "ply", F.posexplode("cells").alias("cell", "label"))
    differ = cells.groupBy(on, "cell").agg((F.min("label") != F.max("label")).alias("differs"))
    probs = (
        frames.select(on, F.posexplode("log_probs").alias("cell", "p"))
        .select(on, "cell", "p", (F.array_position("p", F.array_max("p")) - 1).alias("top"))
    )
    met = cells.join(differ, [on, "cell"]).join(probs, [on, "cell"])
    return (
        met.groupBy(on, "ply")
        .agg(
            F.sum((F.col("top") != F.col("label")).cast("int")).alias("fit"),
            F.round(F.sum(F.when(F.col("differs"), F.get("p", F.col("label"))).otherwise(0.0)), 6).alias("score"),
        )
    )


def gate(scored: DataFrame, on: str, placement: str = "placement", fit_limit: float = FIT, margin_limit: float = MARGIN) -> DataFrame:
    """Per key the candidate of the best score (lowest ply on a tie), its margin over other placements, and its bucket.

    No other placement: margin null, which passes. One best per placement is enough, so rivals are two
    aggregations away, not pairs.
    """
    per = (
        scored.groupBy(on, placement)
        .agg(F.max(F.struct(F.col("score"), (-F.col("ply")).alias("minus"), F.col("fit"))).alias("b"), F.count("*").alias("plies"))
    )
    best = F.struct(
        F.col("b.score").alias("score"),
        F.col("b.minus").alias("minus"),
        F.col("b.fit").alias("fit"),
        F.col(placement).alias("placement"),
        F.col("plies"),
    )
    top = per.groupBy(on).agg(F.max(best).alias("top"), F.sort_array(F.collect_list("b.score"), False).alias("scores"))
    margin = F.when(F.size("scores") > 1, F.get("scores", F.lit(0)) - F.get("scores", F.lit(1)))
    out = top.select(
        on,
        (-F.col("top.minus")).alias("ply"),
        F.col("top.fit").alias("fit"),
        F.round(margin, 6).alias("margin"),
        (F.col("top.plies") > 1).alias("repetition"),
    )
    fits, clear = F.col("fit") <= fit_limit, F.coalesce(F.col("margin") >= margin_limit, F.lit(True))
    return out.withColumn("bucket", F.when(fits & clear, "accept").when(fits | clear, "review").otherwise("quarantine"))
