"""Clock readings against recorded timelines, and the place that a reading names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.operators.timeline import range_join

#: Seconds that a still clock may differ from its record, and a running one from its bounds.
STILL, RUNNING = 2, 3
#: Sizes of the ranges that intervals of whole seconds are made of: 1, 2, 4 to 2^LEVELS.
LEVELS = 12


def usable(clocks: Column) -> Column:
    """Two readings at least, neither of the first two zero: an overlay that isn't loaded shows zeros."""
    return F.coalesce((F.size(clocks) >= 2) & ~F.array_contains(F.slice(clocks, 1, 2), 0), F.lit(False))


def _sides(df: DataFrame, white: str, black: str, more: list[str]) -> DataFrame:
    """A row for each side as the still one: still and running are the two clocks."""
    side = lambda name, still, running: F.struct(F.lit(name).alias("side"), F.col(still).cast("double").alias("still"), F.col(running).cast("double").alias("running"))
    return df.select(*more, F.inline(F.array(side("white", white, black), side("black", black, white))))


def _recorded(positions: DataFrame, on: list[str], still: float, running: float) -> DataFrame:
    """on, game, ply, side, recorded, and what a reading must keep: its still clock low to high, its running one least to most."""
    w = Window.partitionBy(*on, "game").orderBy("ply")
    following = F.when(F.col("turn") == "white", F.lead("white_clk").over(w)).otherwise(F.lead("black_clk").over(w))
    known = positions.withColumn("next", following).where("white_clk is not null and black_clk is not null")
    white_still = F.col("turn") == "black"
    rec = known.select(
        *on,
        "game",
        "ply",
        F.when(white_still, "white").otherwise("black").alias("side"),
        F.when(white_still, F.col("white_clk")).otherwise(F.col("black_clk")).alias("recorded"),
        (F.coalesce(F.col("next") - F.col("increment"), F.lit(0)) - running).alias("least"),
        (F.when(white_still, F.col("black_clk")).otherwise(F.col("white_clk")) + running).alias("most"),
    )
    return rec.withColumn("low", F.col("recorded") - still).withColumn("high", F.col("recorded") + still)


def clock_matches(obs: DataFrame, positions: DataFrame, on: list[str], still: int = STILL, running: int = RUNNING) -> DataFrame:
    """obs_id, game, ply, side and residual of each place whose clocks fit a reading.

    obs has obs_id, white_obs and black_obs; positions has game, ply, turn (the side to move), white_clk, black_clk and
    increment; both have the columns on. The side that moved last stands still: its clock is as recorded, within
    still. The other runs: it is between its next recorded value less the increment (zero without one) and its value,
    within running. Places and readings without both clocks fit nothing. Readings and places meet in buckets of
    the still clock, so no reading is held against a whole timeline; equal clocks at several places all fit.
    """
    rec = _recorded(positions, on, still, running)
    read = _sides(obs.where("white_obs is not null and black_obs is not null"), "white_obs", "black_obs", ["obs_id", *on])
    met = (
        range_join(read, rec, [*on, "side"], "still", "low", "high", 4.0 * still + 2)
        .where(F.col("running").between(F.col("least"), F.col("most")))
    )
    return met.select("obs_id", "game", "ply", "side", F.abs(F.col("still") - F.col("recorded")).alias("residual"))


def _best_of_all(obs: DataFrame, positions: DataFrame, on: list[str], still: float, running: float, rank: Column) -> DataFrame:
    """obs_id and b, the rank of the best place of each reading among all places with equal columns on.

    As clock_matches() finds them, without every pair: of places with one recorded clock only the least game and ply can
    be the best, so each range of a running clock keeps that one. An interval is made of few ranges of 2^0 to 2^LEVELS
    whole seconds, and of its two ends; a reading meets the ranges that it lies in, once for all readings alike. So
    what grows is in proportion to places and readings, times the recorded clocks within still of a reading, which
    are few where clocks are whole seconds.
    """
    side = [*on, "side"]
    rec = _recorded(positions, on, still, running).where("least <= most")
    place = rec.groupBy(*side, "recorded", "low", "high", "least", "most").agg(F.min(F.struct("game", "ply")).alias("at"))
    first, last = F.floor("least"), F.floor("most")
    part = lambda level, cell, lo=None, hi=None: F.struct(
        F.lit(level).alias("level"), cell.alias("cell"), F.lit(lo).cast("double").alias("lo"), F.lit(hi).cast("double").alias("hi")
    )
    end = lambda c: part(-1, c, F.greatest(F.col("least").cast("double"), c.cast("double")), F.least(F.col("most").cast("double"), (c + 1).cast("double")))
    parts = [F.array(end(first)), F.when(last > first, F.array(end(last))).otherwise(F.array())]
    for level in range(LEVELS + 1):  # whole seconds first + 1 to last - 1
        a, b = -F.shiftright(-(first + 1), level), F.shiftright(last, level)
        if level == LEVELS:
            parts.append(F.when(a < b, F.transform(F.sequence(a, b - 1), lambda c: part(LEVELS, c))).otherwise(F.array()))
        else:
            parts.append(F.when((a < b) & (a % 2 != 0), F.array(part(level, a))).otherwise(F.array()))
            parts.append(F.when((a < b) & (b % 2 != 0), F.array(part(level, b - 1))).otherwise(F.array()))
    ranges = (
        place.select(*side, "recorded", "low", "high", "at", F.inline(F.concat(*parts)))
        .groupBy(*side, "recorded", "low", "high", "level", "cell", "lo", "hi")
        .agg(F.min("at").alias("at"))
    )
    read = _sides(obs.where("white_obs is not null and black_obs is not null"), "white_obs", "black_obs", ["obs_id", *on])
    alike, second = [*side, "still", "running"], F.floor("running")
    lies = [F.struct(F.lit(-1).alias("level"), second.alias("cell"))]
    lies += [F.struct(F.lit(level).alias("level"), F.shiftright(second, level).alias("cell")) for level in range(LEVELS + 1)]
    asked = read.select(*alike).distinct().select(*alike, F.inline(F.array(*lies)))
    met = (
        range_join(asked, ranges, [*side, "level", "cell"], "still", "low", "high", 4.0 * still + 2)
        .where((F.col("level") >= 0) | F.col("running").between(F.col("lo"), F.col("hi")))
        .select(*alike, "at.game", "at.ply", F.abs(F.col("still") - F.col("recorded")).alias("residual"))
    )
    best = met.groupBy(*alike).agg(rank)
    return read.join(best, alike).groupBy("obs_id").agg(F.min("b").alias("b"))


def identify(obs: DataFrame, positions: DataFrame, on: list[str], named: DataFrame | None = None, still: int = STILL, running: int = RUNNING) -> DataFrame:
    """Every obs_id with game, ply, residual and confidence of its best place, null where none fits.

    obs also has names_read; named (obs_id, game) holds the games that fit the names which were read. A reading with
    names is held against these games alone, so names that fit no game give null and never a place by the clock;
    one without names against all. Confidence is half the closeness of the still clock, plus a half with names.
    The least game wins a tie, in a game the least residual, then the least ply.
    """
    rank = lambda sure: F.min(F.struct((-sure).alias("minus"), "game", "residual", "ply")).alias("b")
    close = 0.5 * F.greatest(F.lit(0.0), 1 - F.col("residual") / max(still, 1))
    best = _best_of_all(obs.where(~F.col("names_read")), positions, on, still, running, rank(close + 0.0))
    if named is not None:
        own = obs.where(F.coalesce("names_read", F.lit(True))).drop("game").join(named.select("obs_id", F.col("game").alias("_own")).distinct(), "obs_id")
        met = clock_matches(own, positions.withColumn("_own", F.col("game")), [*on, "_own"], still, running)
        sure = close + F.when(F.col("names_read"), 0.5).otherwise(0.0)
        best = best.unionByName(met.join(obs.select("obs_id", "names_read"), "obs_id").groupBy("obs_id").agg(rank(sure)))
    return (
        obs.select("obs_id")
        .join(best, "obs_id", "left")
        .select(
            "obs_id",
            F.col("b.game").alias("game"),
            F.col("b.ply").alias("ply"),
            F.col("b.residual").alias("residual"),
            (-F.col("b.minus")).alias("confidence"),
        )
    )
