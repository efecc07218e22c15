"""Splits that keep groups whole, support samples, and fresh ids."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLITS = ("train", "val", "test")


def ratio_of(text: str) -> tuple[int, int, int]:
    """Three whole shares of 100, none negative, from text such as 60,20,20 or 60/20/20; anything else is an error."""
    parts = [p.strip() for p in text.replace("/", ",").split(",")]
    if len(parts) != 3 or not all(p.isascii() and p.isdigit() for p in parts) or sum(map(int, parts)) != 100:
        raise ValueError(f"three whole shares of 100 are needed, not {text!r}")
    return int(parts[0]), int(parts[1]), int(parts[2])


def pattern(ratio: tuple[int, int, int], have: tuple[int, int, int] = (0, 0, 0)) -> tuple[list[tuple[list[int], int]], list[int]]:
    """Splits of fresh groups in turn, by number: runs of turns with how often each comes again, then those that come for ever.

    Each group goes where most is lacking of ratio percent, the first on a tie; whole numbers throughout, so ties are
    ties. As long as a split holds too much it gets no group, and turns among the others depend only on how much more one
    of them lacks than another. So their turns come again and again until a split that held too much lacks as much: how
    often is divided out, not counted, and pinned groups of any number cost no more than a few hundred turns.
    """
    if any(r < 0 for r in ratio) or sum(ratio) != 100:
        raise ValueError("three shares of 100 in all are needed")
    lack = [r * sum(have) - 100 * h for r, h in zip(ratio, have, strict=True)]
    runs: list[tuple[list[int], int]] = []
    past, turns = [tuple(lack)], []  # what was lacking before each turn since the last run, and the turns
    while True:
        lack = [x + r for x, r in zip(lack, ratio, strict=True)]
        at = lack.index(max(lack))
        lack[at] -= 100
        turns.append(at)
        past.append(tuple(lack))
        for size in range(1, min(200, len(turns)) + 1):  # two splits alone come back to the same within 200 turns, three within 100
            cycle, before = turns[-size:], past[-size - 1]
            gain = [a - b for a, b in zip(lack, before, strict=True)]
            if len({gain[k] for k in cycle}) > 1:
                continue
            closing = {k: gain[k] - gain[at] for k in range(3) if k not in cycle}
            if not any(closing.values()):
                return [*runs, (turns[:-size], 1)], cycle
            # a cycle less, and more than turns within a cycle can differ by, so none of the others is chosen before
            times = min((min(lack[j] for j in cycle) - lack[k] - 300) // by - 1 for k, by in closing.items() if by > 0)
            if times > 0:
                runs += [(turns, 1), (cycle, times)]
                lack = [x + times * g for x, g in zip(lack, gain, strict=True)]
                past, turns = [tuple(lack)], []
                break


def turns(n: int, ratio: tuple[int, int, int], have: tuple[int, int, int] = (0, 0, 0)) -> list[str]:
    """Split of each of n fresh groups in turn."""
    once, again = pattern(ratio, have)
    out: list[int] = []
    for run, times in once:
        out += run * min(times, -(-(n - len(out)) // max(1, len(run)))) if len(out) < n else []
    out += again * -(-max(0, n - len(out)) // len(again))
    return [SPLITS[k] for k in out[:n]]


def split_of_turn(turn: Column, ratio: tuple[int, int, int], have: tuple[int, int, int] = (0, 0, 0)) -> Column:
    """Split of the fresh group that comes in a turn, from 0."""
    once, again = pattern(ratio, have)
    digit = lambda run, at: F.substring(F.lit("".join(map(str, run))), (F.pmod(at, F.lit(len(run))) + 1).cast("int"), F.lit(1)).cast("int")
    chosen, start = None, 0
    for run, times in once:
        if run:
            end = start + len(run) * times
            here = digit(run, turn - F.lit(start))
            chosen = F.when(turn < F.lit(end), here) if chosen is None else chosen.when(turn < F.lit(end), here)
            start = end
    last = digit(again, turn - F.lit(start))
    number = last if chosen is None else chosen.otherwise(last)
    return F.get(F.array(*[F.lit(s) for s in SPLITS]), number)


def numbered(df: DataFrame, order: str, name: str, parts: int = 256) -> DataFrame:
    """df with name: the place, from 0, of each row by order, a whole number that names it.

    Rows are placed within ranges of order, at most `parts`, and the ranges by their counts: no task sees all rows.
    """
    bounds = df.agg(F.percentile_approx(F.col(order).cast("long"), [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or []
    edges = F.array(*[F.lit(b).cast("long") for b in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    dealt = df.withColumn("_part", F.size(F.filter(edges, lambda b: b <= F.col(order))))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # at most `parts` rows
    w = Window.partitionBy("_part").orderBy(order)
    return (
        dealt.withColumn("_k", F.row_number().over(w) - 1)
        .join(F.broadcast(before), "_part")
        .withColumn(name, F.col("_before") + F.col("_k"))
        .drop("_part", "_k", "_before")
    )


def fresh_numbers(new: DataFrame, order: str, taken: DataFrame, start: int, name: str, parts: int = 256) -> DataFrame:
    """new with name: for each row, by order, the next number from start on that taken (one column of numbers) lacks.

    Below a number taken stand as many free ones as its distance from start less the numbers taken before it, so
    numbers taken one after the other form an island with the same count. The n-th row, from 0, has start + n and as many
    more as the islands up to n hold. Rows and islands meet in ranges of n, at most `parts`, whose sums go before them:
    no task sees all rows, nor all numbers taken.
    """
    number = taken.columns[0]
    ahead = numbered(taken.select(F.col(number).cast("long").alias("t")).where(F.col("t") >= start).distinct(), "t", "_place", parts)
    islands = ahead.groupBy((F.col("t") - start - F.col("_place")).alias("_n")).agg(F.count("*").alias("_held"))
    placed = numbered(new, order, "_n", parts)
    width = max(1, -(-new.count() // parts))
    rows = placed.select(F.floor(F.col("_n") / width).alias("_range"), "_n", F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_held"), F.struct(*new.columns).alias("_row"))
    gaps = islands.select(F.floor(F.col("_n") / width).alias("_range"), "_n", F.lit(0).alias("_kind"), "_held", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    met = rows.unionByName(gaps.where(F.col("_range") < parts))  # islands beyond the last row hold nothing back
    sums = met.groupBy("_range").agg(F.sum("_held").alias("_of"))
    before = sums.select("_range", (F.sum("_of").over(Window.orderBy("_range")) - F.col("_of")).alias("_before"))  # at most `parts` rows
    w = Window.partitionBy("_range").orderBy("_n", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = met.withColumn("_here", F.sum("_held").over(w)).join(F.broadcast(before), "_range").where("_kind = 1")
    return counted.select("_row.*", (F.lit(start) + F.col("_n") + F.col("_before") + F.col("_here")).alias(name))


def fresh_ids(new: DataFrame, order: str, registry: DataFrame, id_: str, prefix: str, name: str = "fresh") -> DataFrame:
    """new with name: prefix and a number, counted up by order from the size of the registry, past every id that it has."""
    own = F.regexp_extract(id_, f"^{re.escape(prefix)}(0|[1-9][0-9]*)$", 1)
    taken = registry.select(F.when(own != "", own).try_cast("long").alias("t")).where("t is not null")
    out = fresh_numbers(new, order, taken, registry.select(id_).distinct().count(), name)
    return out.withColumn(name, F.concat(F.lit(prefix), F.col(name).cast("string")))


def plan(df: DataFrame, group: str, key: str, seed: int, ratio: tuple[int, int, int] = (60, 20, 20), existing: DataFrame | None = None) -> DataFrame:
    """key and split of every row, whole groups to a split.

    existing (key, split) stays as it is; a group with a member there is pinned to its most frequent split, the
    first of SPLITS on a tie. Fresh groups go in order of size, then of a seeded hash, by pattern(). One row a group is
    ordered, not one a row: within cells of one size and the first two digits of the hash, and the cells by their
    counts.
    """
    groups = df.groupBy(group).agg(F.count("*").alias("_size"))
    rank = F.expr("case split when 'train' then 0 when 'val' then 1 else 2 end")
    pinned = None
    if existing is not None:
        votes = existing.join(df.select(key, group), key).groupBy(group, "split").agg(F.count("*").alias("_v"))
        pinned = (
            votes.groupBy(group)
            .agg(F.max(F.struct(F.col("_v"), (-rank).alias("_r"), F.col("split").alias("_s"))).alias("_p"))
            .select(group, F.col("_p._s").alias("_pinned"))
        )
        fresh = groups.join(pinned, group, "left_anti")
        counted = dict(pinned.groupBy("_pinned").count().collect())
    else:
        fresh, counted = groups, {}
    jitter = F.sha2(F.concat(F.col(group).cast("string"), F.lit(f"-{seed}")), 256)
    dealt = fresh.withColumn("_j", jitter).withColumn("_cell", F.substring("_j", 1, 2))
    counts = dealt.groupBy("_size", "_cell").agg(F.count("*").alias("_n"))
    before = counts.select("_size", "_cell", (F.sum("_n").over(Window.orderBy("_size", "_cell")) - F.col("_n")).alias("_before"))  # cells, not groups
    placed = (
        dealt.withColumn("_k", F.row_number().over(Window.partitionBy("_size", "_cell").orderBy("_j", group)) - 1)
        .join(before, ["_size", "_cell"])
    )
    turn = F.col("_before") + F.col("_k")
    chosen = placed.select(group, split_of_turn(turn, ratio, tuple(counted.get(s, 0) for s in SPLITS)).alias("split"))
    if pinned is not None:
        chosen = chosen.unionByName(pinned.select(group, F.col("_pinned").alias("split")))
    out = df.select(key, group).join(chosen, group).select(key, group, "split")
    if existing is not None:
        out = (
            out.join(existing.select(key, F.col("split").alias("_old")), key, "left")
            .select(key, group, F.coalesce("_old", "split").alias("split"))
        )
    return out


def support(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows in the order of a seeded hash; 0, or no fewer than there are, keeps all."""
    return df if k == 0 else df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(k)
