"""Reviews of candidates: seeds, gates, decisions applied, queues, rebuilds and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def seeded(duplicate: Column, bucket: Column) -> Column:
    """First decision of a candidate: a duplicate is rejected, whatever its bucket."""
    return F.when(duplicate, "reject").when(bucket == "accept", "accept").when(bucket == "review", "undecided").otherwise("reject")


def bucketed(candidates: DataFrame, timelines: DataFrame, key: str, fit_limit: float, margin_limit: float) -> DataFrame:
    """key, bucket, fit and margin of every candidate; one without a timeline goes to review with fit -1 and no margin."""
    met = candidates.join(timelines.select(key, "fit", "margin", F.lit(True).alias("_t")), key, "left")
    fits, clear = F.col("fit") <= fit_limit, F.coalesce(F.col("margin") >= margin_limit, F.lit(True))
    bucket = F.when(F.col("_t").isNull(), "review").when(fits & clear, "accept").when(fits | clear, "review").otherwise("quarantine")
    return met.select(
        key,
        bucket.alias("bucket"),
        F.when(F.col("_t").isNull(), F.lit(-1).cast("long")).otherwise(F.col("fit")).alias("fit"),
        "margin",
    )


def applied(rows: DataFrame, decisions: DataFrame, corrections: DataFrame, key: str, values: list[str]) -> DataFrame:
    """rows (key, values, verified) after review: rejected ones go, corrected ones get the correction's values.

    Accepted and corrected ones are verified, as are those that were before; the rest stays as it is.
    """
    left = rows.join(decisions.where("decision = 'reject'").select(key), key, "left_anti")
    left = left.join(decisions.where("decision <> 'reject'").select(key, F.lit(True).alias("_seen")), key, "left")
    fixed = corrections.select(key, F.struct(*values).alias("_c"))
    met = left.join(fixed, key, "left")
    own = [F.when(F.col("_c").isNotNull(), F.col("_c")[v]).otherwise(F.col(v)).alias(v) for v in values]
    verified = F.col("verified") | F.coalesce("_seen", F.lit(False)) | F.col("_c").isNotNull()
    return met.select(*[c for c in rows.columns if c not in (*values, "verified")], *own, verified.alias("verified"))


def preseeded(candidates: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """candidates with verified: whether their key was verified before."""
    return (
        candidates.join(verified.select(key).distinct().withColumn("_v", F.lit(True)), key, "left")
        .withColumn("verified", F.coalesce("_v", F.lit(False)))
        .drop("_v")
    )


def rebuilt(old: DataFrame, fresh: DataFrame, scope: Column, key: str) -> DataFrame:
    """old outside scope as kept, fresh as built, and as dropped what old has in scope and fresh lacks."""
    inside = old.where(F.coalesce(scope, F.lit(False)))
    outside = old.where(~F.coalesce(scope, F.lit(False)))
    mark = lambda df, change: df.withColumn("change", F.lit(change))
    return (
        mark(outside, "kept")
        .unionByName(mark(fresh, "built"))
        .unionByName(mark(inside.join(fresh.select(key), key, "left_anti"), "dropped"))
    )


def batch_state(requests: DataFrame, answers: DataFrame, key: str, error: str) -> DataFrame:
    """key and state of every request: pending without an answer, failed with errors alone, else done."""
    seen = answers.groupBy(key).agg(F.bool_and(error).alias("_failed"))
    state = F.when(F.col("_failed").isNull(), "pending").when(F.col("_failed"), "failed").otherwise("done")
    return requests.join(seen, key, "left").select(key, state.alias("state"))


def patient(steps: DataFrame, by: str, step: str, score: list[str], patience: int) -> DataFrame:
    """best_step, last_step and stopped_early of each run: it ends once patience steps in a row weren't better.

    score is compared column by column. Steps are 0, 1, 2 and so on.
    """
    w = Window.partitionBy(by).orderBy(step)
    before = F.max(F.struct(*score)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.struct(*score) > before)
    seen = steps.withColumn("_better", better).withColumn("_best", F.max(F.when(F.col("_better"), F.col(step))).over(w))
    stop = F.min(F.when(F.col(step) - F.col("_best") >= patience, F.col(step))).over(Window.partitionBy(by))
    run = seen.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col(step) <= F.col("_stop")))
    return (
        run.groupBy(by)
        .agg(
            F.max("_best").alias("best_step"),
            F.max(step).alias("last_step"),
            F.bool_or(F.col("_stop").isNotNull()).alias("stopped_early"),
        )
    )


def grouping_unit(split_by: str, game: Column, video: Column, frame: Column) -> Column:
    """What is kept together by frame, video or game; a game that is missing falls back to the video, that to the frame."""
    if split_by not in ("frame", "video", "game"):
        raise ValueError(f"no such unit: {split_by}")
    return frame if split_by == "frame" else F.coalesce(video, frame) if split_by == "video" else F.coalesce(game, video, frame)


def with_splits(rows: DataFrame, dataset: str, split: str, needed: list[str]) -> DataFrame:
    """Datasets that have every one of the needed splits."""
    return (
        rows.groupBy(dataset)
        .agg(*[F.bool_or(F.col(split) == s).alias(s) for s in needed])
        .where(" and ".join(f"`{s}`" for s in needed))
        .select(dataset)
    )


def sharpest(views: DataFrame, by: list[str], sharpness: str, order: str) -> DataFrame:
    """The row of the greatest sharpness of each view, the first in order on a tie; null counts as -1."""
    seen = views.withColumn(sharpness, F.coalesce(sharpness, F.lit(-1.0)))
    w = Window.partitionBy(*by).orderBy(F.desc(sharpness), order)
    return seen.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def layout(board: Column, clock: Column, plates: Column) -> Column:
    """processable with all rectangles, board only with the board's, else requires curation."""
    return F.when(board.isNull(), "requires curation").when(clock.isNotNull() & plates.isNotNull(), "processable").otherwise("board only")


def engine_scores(rows: DataFrame, engines: list[str]) -> DataFrame:
    """n, shares of white, black and both read, and mean secs of each engine; 0 for one without rows."""
    share = lambda c: F.avg(c.cast("double"))
    got = (
        rows.groupBy("engine")
        .agg(
            F.count("*").alias("n"),
            share(F.col("white")).alias("white"),
            share(F.col("black")).alias("black"),
            share(F.col("white") & F.col("black")).alias("pair"),
            F.avg("secs").alias("secs"),
        )
    )
    all_ = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(e) for e in engines])).alias("engine"))
    none = F.lit(0.0)
    return (
        all_.join(got, "engine", "left")
        .select(
            "engine",
            F.coalesce("n", F.lit(0).cast("long")).alias("n"),
            *[F.round(F.coalesce(c, none), 6).alias(c) for c in ("white", "black", "pair", "secs")],
        )
    )


def inserted(rows: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """key and inserted of every row that goes in only where its key is absent."""
    return (
        rows.join(held.select(key).distinct().withColumn("_h", F.lit(True)), key, "left")
        .select(key, F.col("_h").isNull().alias("inserted"))
    )


def paired(predictions: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Both sides by key, with status: paired, missing (no prediction) or unexpected (no truth)."""
    p, t = predictions.withColumn("_p", F.lit(True)), truth.withColumn("_t", F.lit(True))
    status = F.when(F.col("_p").isNull(), "missing").when(F.col("_t").isNull(), "unexpected").otherwise("paired")
    return p.join(t, key, "full").withColumn("status", status).drop("_p", "_t")


def rounds_of(videos: DataFrame, entries: DataFrame, rounds: DataFrame) -> DataFrame:
    """video and round of each video: its own list where that has any, or else every round of its tournaments.

    entries has video, round_ids and tournaments, rounds has tournament and round. A video that isn't among entries,
    or has neither list, ends the job with an error that names it; none goes missing without a word.
    """
    known = videos.select("video").distinct().join(entries.select("video", "round_ids", "tournaments", F.lit(True).alias("known")), "video", "left")
    no_round, no_tournament = (F.lit(None).cast(dict(rounds.dtypes)[c]) for c in ("round", "tournament"))
    wrong = F.concat(F.when(F.col("known").isNull(), F.lit("unregistered video ")).otherwise(F.lit("no rounds or tournaments for video ")), F.col("video").cast("string"))
    targets = (  # the error is part of what is taken apart, so no plan can do without it
        F.when(F.size("round_ids") > 0, F.transform("round_ids", lambda r: F.struct(r.alias("round"), no_tournament.alias("tournament"))))
        .when(F.size("tournaments") > 0, F.transform("tournaments", lambda t: F.struct(no_round.alias("round"), t.alias("tournament"))))
        .otherwise(F.raise_error(wrong))
    )
    found = known.select("video", F.explode(targets).alias("t")).select("video", "t.*")
    mapped = found.where("tournament is not null").select("video", "tournament").join(rounds, "tournament").select("video", "round")
    return found.where("tournament is null").select("video", "round").unionByName(mapped)
