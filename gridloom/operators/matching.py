"""Matching of names and boards: oriented before unordered, equal parts before distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions import board, text


def oriented_else_unordered(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of pairs with flags oriented and unordered: the oriented ones of each key, or else its unordered ones."""
    any_oriented = F.max(F.col("oriented").cast("int")).over(Window.partitionBy(*by))
    return pairs.withColumn("_any", any_oriented).where(F.col("oriented") | ((F.col("_any") == 0) & F.col("unordered"))).drop("_any")


#: Known boards with one part in common beyond which that part alone brings no board to them.
CROWD = 256


def _parts(cells: Column, places: Column, parts: int) -> Column:
    """number and hash of each of so many parts of the cells at places, an array of their indices."""
    size = F.size(places)
    edge = lambda k: F.floor(size * k / parts).cast("int")
    part = lambda k: F.transform(F.slice(places, edge(k) + 1, edge(k + 1) - edge(k)), lambda i: F.get(cells, i))
    return F.array(*[F.xxhash64(F.lit(k), part(k)) for k in range(parts)])


def hamming_nearest(obs: DataFrame, known: DataFrame, most: int, crowd: int = CROWD) -> DataFrame:
    """obs (obs_id, cells) with known_id and diff of the nearest of known (known_id, cells), null beyond most.

    Two boards with at most `most` differing cells agree on one of most + 1 parts, so the join is an equal one
    on the parts; the least known_id wins a tie. Where a part is common to more than `crowd` of known, equal boards of known are one, of
    the least id, and a part that more than `crowd` of them have in common, such as an empty middle, is refined: boards that agree on it and differ in at most
    `most` cells agree on one of as many parts of the other cells too, so the same boards are found.
    """
    parts = most + 1
    edges = [64 * k // parts for k in range(parts + 1)]
    every = F.array(*map(F.lit, range(64)))
    numbered = lambda cells: F.array(*[F.struct(F.lit(k).alias("at"), F.xxhash64(F.lit(k), F.slice(cells, a + 1, b - a)).alias("part")) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    own = lambda df: df.select("known_id", F.col("cells").alias("k"), F.explode(numbered(F.col("cells"))).alias("p")).select("known_id", "k", "p.*")
    asked = obs.select("obs_id", F.col("cells").alias("o"), F.explode(numbered(F.col("cells"))).alias("p")).select("obs_id", "o", "p.*")
    counts = lambda df: own(df).groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > crowd)

    def rest(at: Column) -> Column:
        """The cells beyond part number at."""
        bounds = F.array(*[F.struct(F.lit(a), F.lit(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)])
        inside = F.get(bounds, at)
        return F.filter(every, lambda i: (i < inside["col1"]) | (i >= inside["col2"]))

    def keyed(df: DataFrame, cells: str) -> DataFrame:
        told = df.join(crowded, "part", "left")
        finer = F.transform(_parts(F.col(cells), rest(F.col("at")), parts), lambda h: F.xxhash64("part", h))
        return told.withColumn("key", F.explode(F.when(F.col("crowded"), finer).otherwise(F.array("part")))).drop("part", "at", "crowded")

    if counts(known).isEmpty():
        left, right, key = asked, own(known), "part"
    else:
        one = known.groupBy("cells").agg(F.min("known_id").alias("known_id"))
        crowded = counts(one).select("part", F.lit(True).alias("crowded"))
        left, right, key = keyed(asked, "o"), keyed(own(one), "k"), "key"
    met = (
        left.join(right, key)
        .select("obs_id", "known_id", board.hamming(F.col("o"), F.col("k")).alias("diff"))
        .where(F.col("diff") <= most)
    )
    best = met.groupBy("obs_id").agg(F.min(F.struct("diff", "known_id")).alias("b"))
    found = (
        obs.select("obs_id")
        .join(best, "obs_id", "left")
        .select("obs_id", F.col("b.known_id").alias("known_id"), F.col("b.diff").alias("diff"))
    )
    return found.withColumn("confidence", F.greatest(F.lit(0.0), 1 - F.col("diff") / (most + 1.0)))


def _grams(name: Column) -> Column:
    """Distinct runs of three letters; a shorter text is its own."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - 2, F.lit(1))), lambda i: F.substring(name, i, F.lit(3)))
    return F.array_distinct(runs)


def _rarest(texts: DataFrame, of: str, among: DataFrame) -> DataFrame:
    """of and _g: of each text's runs of three letters that which the fewest of among (_g, one row each) have; none if one has none."""
    held = among.groupBy("_g").agg(F.count("*").alias("_n"))
    runs = texts.select(of, F.explode(_grams(F.col(of))).alias("_g")).join(held, "_g", "left")
    return runs.groupBy(of).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g"))).alias("r")).where("r.n > 0").select(of, F.col("r.g").alias("_g"))


def names_in(names: DataFrame, name: str, blobs: DataFrame, blob: str) -> DataFrame:
    """Pairs (name, blob) of distinct names and blobs in which name_in() reads the name.

    A name within a blob has all its runs of three letters in common with it, a word within a name all its own, so
    pairs come from equal joins on the rarest of these, whichever runs are common; names and words of fewer
    letters are looked up as they stand. Words are held against names once, not once a blob.
    """
    n, b = names.select(name).distinct(), blobs.select(blob).distinct()
    words = b.select(blob, F.explode(F.array_distinct(F.filter(F.split(blob, r"\s+"), lambda w: w != ""))).alias("_w"))
    short = F.flatten(
        F.transform(
            F.array(F.lit(1), F.lit(2)),
            lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(blob) - k + 1, F.lit(1))), lambda i: F.substring(blob, i, k)),
        ),
    )
    in_blobs = b.select(blob, F.explode(F.array_distinct(F.concat(_grams(F.col(blob)), short))).alias("_g"))
    within = _rarest(n, name, in_blobs).join(in_blobs, "_g").select(name, blob)
    in_names = n.select(name, F.explode(_grams(F.col(name))).alias("_g"))
    inside = _rarest(words.select("_w").distinct(), "_w", in_names).join(in_names, "_g").where(F.contains(name, F.col("_w"))).select(name, "_w")
    pairs = within.union(inside.join(words, "_w").select(name, blob))
    return pairs.where(text.name_in(F.col(name), F.col(blob))).distinct()


def best_oriented(df: DataFrame, by: str, key: str, side: str, value: str, within: int) -> DataFrame:
    """key with match, oriented and matches: the least other key of its group with the same side, or else the nearest by value.

    Where no other row of the group has the side, rows within `within` of its value count, the nearest first, the one
    below on a tie. Windows over the group give both, so no pairs are made.
    """
    w = Window.partitionBy(by, side)
    least = F.min(key).over(w)
    second = F.min(F.when(F.col(key) != F.col("_l"), F.col(key))).over(w)
    placed = df.withColumn("_l", least).withColumn("_s", second).withColumn("_n", F.count("*").over(w) - 1)
    near = Window.partitionBy(by).orderBy(value, key)
    around = Window.partitionBy(by).orderBy(F.col(value)).rangeBetween(-within, within)
    placed = (
        placed.withColumn("_b", F.lag(F.struct(key, value)).over(near))
        .withColumn("_a", F.lead(F.struct(key, value)).over(near))
        .withColumn("_m", F.count("*").over(around) - 1)
    )
    below, above = F.col(value) - F.col(f"_b.{value}"), F.col(f"_a.{value}") - F.col(value)
    fallback = F.when((below <= within) & (above.isNull() | (below <= above)), F.col(f"_b.{key}")).when(above <= within, F.col(f"_a.{key}"))
    oriented = F.col("_n") > 0
    match = F.when(oriented, F.when(F.col(key) == F.col("_l"), F.col("_s")).otherwise(F.col("_l"))).otherwise(fallback)
    return placed.select(
        key,
        match.alias("match"),
        oriented.alias("oriented"),
        F.when(oriented, F.col("_n")).otherwise(F.col("_m")).alias("matches"),
    )
