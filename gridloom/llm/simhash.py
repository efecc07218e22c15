"""SimHash near duplicates: a grid over segment bit counts, then exact distances, then groups.

A fingerprint is embedded as the bit counts of its segments. Flipping one bit changes one count by one, so the
Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints. With the coordinates
in GROUPS groups, at most max_bits groups of two linked fingerprints differ, so they share the grid cell of
some GROUPS - max_bits groups: the range join is an equal join on these cells, and loses nothing. Pairs of a
cell are held against the Manhattan distance, then against the exact one.

A cell of more than CROWDED fingerprints isn't paired up. Its members meet instead at the fingerprints one
flipped bit away: two within two bits of each other have one in common and no others do, so groups come out
the same with a number of rows in proportion to the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, documents, importable, stored

WORDS, BITS, MAX_BITS, SEED = 3, 64, 2, 42
#: Bits of a segment, groups of segments, and the most fingerprints of a cell that are paired up.
SEGMENT, GROUPS, CROWDED = 2, 4, 32


def text_fingerprint(text: str | None, words: int) -> int:
    """SimHash of the word shingles, repeats included: a bit is set if it is in over half of their hashes."""
    from xxhash import xxh64_intdigest

    # bytes.lower() changes A-Z only and bytes.split() cuts at ASCII white space only
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    h = np.array([xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(n)], ">u8")
    set_ = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_ * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (bigint) of every row; null and empty texts have fingerprint 0."""
    import pyarrow as pa

    importable(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            fp = pa.array([text_fingerprint(t.as_py(), words) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(run, "doc_id bigint, fp bigint")
    )


def _counts(fp: Column, segments: range) -> Column:
    """Bit counts of some segments, packed; a count of SEGMENT bits fits into as many."""
    packed = F.lit(0).cast("long")
    for at, k in enumerate(segments):
        count = F.bit_count(F.shiftrightunsigned(fp, k * SEGMENT).bitwiseAND((1 << SEGMENT) - 1)).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(count, at * SEGMENT))
    return packed


def manhattan(a: Column, b: Column) -> Column:
    """Manhattan distance of the embeddings of two fingerprints."""
    one = lambda fp, k: F.bit_count(F.shiftrightunsigned(fp, k * SEGMENT).bitwiseAND((1 << SEGMENT) - 1))
    total = F.lit(0)
    for k in range(BITS // SEGMENT):
        total = total + F.abs(one(a, k) - one(b, k))
    return total


def cells(fps: DataFrame, max_bits: int = MAX_BITS, groups: int = GROUPS) -> DataFrame:
    """fp and cell, for each choice of groups - max_bits groups of coordinates."""
    per = BITS // SEGMENT // groups
    parts = [_counts(F.col("fp"), range(g * per, (g + 1) * per)) for g in range(groups)]
    keyed = [F.xxhash64(F.lit(n), *[parts[g] for g in some]) for n, some in enumerate(combinations(range(groups), groups - max_bits))]
    return fps.select("fp", F.explode(F.array(*keyed)).alias("cell"))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """a and b, for which following links leads from each distinct fp to all that are reachable in steps of max_bits bits (0 to 2).

    Crowded cells meet at flipped bits: members within two bits have a flip in common, those within one are flips of each
    other.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("fingerprints link at 0, 1 or 2 differing bits")
    placed = stored(cells(fps, max_bits), "cells")
    sized = placed.groupBy("cell").count().where("count > 1")
    few = placed.join(sized.where(F.col("count") <= CROWDED).select("cell"), "cell")
    left, right = few.select("cell", F.col("fp").alias("a")), few.select("cell", F.col("fp").alias("b"))
    pairs = (
        left.join(right, "cell")
        .where(
            (F.col("a") < F.col("b")) & (manhattan(F.col("a"), F.col("b")) <= max_bits) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits),
        )
    )
    pairs = pairs.select("a", "b").distinct()
    if max_bits == 0:  # distinct fingerprints differ
        return pairs
    crowd = placed.join(sized.where(F.col("count") > CROWDED).select("cell"), "cell", "left_semi").select("fp").distinct()
    flips = F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(BITS)])
    near = (
        crowd.select(F.col("fp").alias("a"), F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("x"))
        .select("a", F.col("a").bitwiseXOR(F.col("x")).alias("b"))
    )
    if max_bits == 1:
        return pairs.union(near.where("a < b").join(crowd.select(F.col("fp").alias("b")), "b", "left_semi").select("a", "b"))
    # only those that two members share lead anywhere
    shared = near.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("z")).where("a < z").select("b", F.col("a").alias("least"))
    met = near.join(shared, "b").where(F.col("a") != F.col("least")).select("a", F.col("least").alias("b")).distinct()
    return pairs.union(met)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and root (the least node reachable) of every node of edges (a, b): large stars and small stars in turn.

    Each round is a table in the shared folder; what reaches the driver is two numbers a round.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now, before = stored(edges.select("a", "b").where("a <> b").distinct(), name), None
    while True:
        # large star: what is larger than a node goes to the least of its surroundings
        around = both(now)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller ones go to the least of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        now = stored(small, name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def groups(docs: DataFrame, words: int = WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp and component_id of every row; the component is the least doc_id reachable by links.

    Texts of one fingerprint are linked, empty ones and null ones too. Repeated rows stay repeated; a null
    doc_id belongs to a group without naming it.
    """
    found = stored(fingerprints(docs, words), "fingerprints")
    firsts = stored(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp"), max_bits))
    named = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    member = named.join(ids, "root").select(F.col("fp").alias("of"), "component_id")
    return found.join(member, found["fp"] == member["of"]).select("doc_id", "fp", "component_id")


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint and component_id of every document; null and empty texts have fingerprint zero."""
    out = groups(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: The filter takes five words and this likeness; classes of a text, shingles of a class on average, and as above
#: the most texts of a key that are paired up at once; of more, each is first held against so many leaders. Rows
#: of a common shingle that meet in one task.
NEAR_WORDS, NEAR, CLASSES, CLASS_SHINGLES, PAIRED, LEADERS, BLOCK = 5, 0.8, 16, 4, 16, 3, 512


def class_keys(text: str | None, words: int = NEAR_WORDS) -> list[int]:
    """Keys that two texts of likeness NEAR or more almost surely share: SimHashes of classes of shingles.

    The distinct shingle hashes are dealt into 2^level classes by their low bits, with 4 to 8 in a class at the
    text's own level and half as many at the next, so texts of like sizes have a level in common. A class is
    untouched if none of its shingles differs, and then its fingerprint is the same.
    """
    from xxhash import xxh64_intdigest

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return []
    h = np.unique(np.array([xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(max(1, len(w) - words + 1))], np.uint64))
    own = max(0, (len(h) // CLASS_SHINGLES).bit_length() - 1)
    out: list[int] = []
    for level in (own, own + 1):
        cls = h & np.uint64((1 << level) - 1)
        some = cls < CLASSES
        if not some.any():
            continue
        order = np.argsort(cls[some], kind="stable")
        c, x = cls[some][order], h[some][order]
        first = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
        size = np.diff(np.append(first, len(c)))
        bits = np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        fp = np.packbits(np.add.reduceat(bits, first, axis=0, dtype=np.int64) * 2 > size[:, None], axis=1)
        out += [xxh64_intdigest(bytes([level, int(k)]) + f.tobytes(), SEED) - (1 << 63) for k, f in zip(c[first], fp, strict=True)]
    return out


def held(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (a, b) of asked whose sets (tid, s) have a likeness of NEAR or more."""
    both = F.size(F.array_intersect("sa", "sb"))
    of = (
        asked.join(sets.select(F.col("tid").alias("a"), F.col("s").alias("sa")), "a")
        .join(sets.select(F.col("tid").alias("b"), F.col("s").alias("sb")), "b")
    )
    return of.where(both >= NEAR * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """a and b of different roots: all pairs of sets (tid, root, s) that can have a likeness of NEAR or more.

    Of two such sets each lacks at most 1 - NEAR of the other's shingles, so with the shingles in one order, rarest
    first, both have one of their first 1 - NEAR in common, plus one. Shingles of one text alone come first and are
    only counted. If a shingle is the first that two sets have in common, they share no more than either has from it on:
    that must reach what two sets of their sizes need for NEAR. A shingle's rows outside its largest root meet all
    of its rows, in blocks of BLOCK.
    """
    each = stored(sets.select("tid", "root", F.size("s").alias("size"), F.explode("s").alias("x")), "shingles")
    common = each.groupBy("x").agg(F.count("*").alias("n")).where("n > 1")
    first = F.col("size") - F.ceil(F.col("size") * NEAR - 1e-9) + 1 - (F.col("size") - F.size("xs"))
    own = each.join(common, "x").groupBy("tid", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("xs"))
    prefix = stored(
        own.where(first > 0)
        .select("tid", "root", "size", F.size("xs").alias("n"), F.posexplode(F.slice("xs", F.lit(1), first.cast("int"))).alias("at", "p"))
        .select("tid", "root", "size", (F.col("n") - F.col("at")).alias("rest"), "p.x"),
        "prefixes",
    )
    roots = (
        prefix.groupBy("x", "root")
        .agg(F.count("*").alias("n"))
        .groupBy("x")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("k"))
    )
    mixed = roots.where("k > 1").select("x", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.col("m.root").alias("main"))
    dealt = prefix.join(mixed, "x")
    left = (
        dealt.where("root <> main")
        .select(
            "x",
            "main",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
            F.col("tid").alias("a"),
            F.col("root").alias("ra"),
            F.col("size").alias("na"),
            F.col("rest").alias("from_a"),
        )
    )
    right = dealt.select(
        "x",
        F.pmod(F.xxhash64("tid"), F.col("blocks")).alias("block"),
        F.col("tid").alias("b"),
        F.col("root").alias("rb"),
        F.col("size").alias("nb"),
        F.col("rest").alias("from_b"),
    )
    needed = F.ceil((F.col("na") + F.col("nb")) * (NEAR / (1 + NEAR)) - 1e-9)
    once = (F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))
    met = left.join(right, ["x", "block"]).where((F.col("ra") != F.col("rb")) & once & (F.least("from_a", "from_b") >= needed))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grid_keys(texts: DataFrame) -> DataFrame:
    """tid and key of every text: one key for all whose fingerprints the grid links, in steps of MAX_BITS bits."""
    named = texts.select(F.col("tid").alias("doc_id"), "text")
    found = stored(fingerprints(named).select(F.col("doc_id").alias("tid"), "fp"), "near_fingerprints")
    roots = components(links(found.select("fp").distinct()), "near_grid")
    return found.join(roots, found["fp"] == roots["node"], "left").select("tid", F.xxhash64(F.lit("grid"), F.coalesce("root", "fp")).alias("key"))


def near_roots(texts: DataFrame) -> DataFrame:
    """node and root of every text (tid, text; each tid once) that is linked: a likeness of NEAR or more in shingles of NEAR_WORDS words.

    Texts that op7's grid groups have a key in common, and so have those with a class of shingles alike, which finds
    links of more bits. Texts with a key in common are held against each other exactly, by their sets of shingle hashes; of a key
    with more than PAIRED texts, each against the first LEADERS. Where that leaves more than one group in such a
    key, all links between the groups are searched by prefix_pairs(), so a crowded key loses none; links
    within a group change nothing.
    """
    import pyarrow as pa

    importable(texts.sparkSession)

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            keys = [class_keys(t.as_py()) for t in batch.column("text")]
            tid = np.repeat(batch.column("tid").to_numpy(zero_copy_only=False), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tid, pa.int64()), pa.array([x for k in keys for x in k], pa.int64())],
                names=["tid", "key"],
            )

    classes = texts.select("tid", "text").mapInArrow(run, "tid bigint, key bigint")
    keyed = stored(classes.unionByName(grid_keys(texts)), "keys")
    sized = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("tid").alias("l0")).where("n > 1")
    few = keyed.join(sized.where(F.col("n") <= PAIRED).select("key"), "key")
    pairs = few.select("key", F.col("tid").alias("a")).join(few.select("key", F.col("tid").alias("b")), "key").where("a < b").select("a", "b")
    # leaders: the least ids, one after the other, so no key's texts meet in one task
    crowd, lead = keyed.join(sized.where(F.col("n") > PAIRED).select("key", "l0"), "key"), "l0"
    for k in range(1, LEADERS):
        following = crowd.where(F.col("tid") > F.col(lead)).groupBy("key").agg(F.min("tid").alias(f"l{k}"))
        crowd, lead = crowd.join(following, "key"), f"l{k}"
    star = crowd.select("tid", F.explode(F.array(*[F.col(f"l{k}") for k in range(LEADERS)])).alias("l")).where("tid <> l")
    asked = stored(pairs.union(star.select(F.least("tid", "l").alias("a"), F.greatest("tid", "l").alias("b"))).distinct(), "asked")

    wanted = asked.select(F.col("a").alias("tid")).union(asked.select(F.col("b").alias("tid"))).distinct()
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - NEAR_WORDS + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, NEAR_WORDS)))
    sets = stored(
        texts.join(wanted, "tid", "left_semi").select("tid", words.alias("w")).select("tid", F.array_distinct(shingles).alias("s")),
        "sets",
    )
    links = stored(held(asked, sets), "links")
    roots = components(links, "near")

    # crowded keys whose texts are still in more than one group
    crowded = keyed.join(sized.where(F.col("n") > PAIRED).select("key"), "key", "left_semi")
    rooted = stored(
        crowded.join(roots, crowded["tid"] == roots["node"], "left").select("key", "tid", F.coalesce("root", "tid").alias("root")),
        "rooted",
    )
    spread = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    left = rooted.join(spread, "key", "left_semi").select("tid", "root").distinct()
    more = stored(held(stored(prefix_pairs(left.join(sets, "tid")), "asked_more"), sets), "links_more")
    return roots if more.isEmpty() else components(links.union(more), "near_all")


def text_keys(text: Column) -> tuple[Column, Column]:
    """A text's node (64 bits) and check (32 more): equal texts have equal ones, others not both."""
    return F.xxhash64(text), F.hash(text)


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each group of texts linked by near_roots() the least doc_id stays.

    Equal texts are one group, null and empty ones too; null ids come first. Of rows with one id and text the one whose
    JSON has the least hash stays, so a retry keeps the same. Of texts
    that share a node by chance, which their checks tell apart, the others stay unlinked: none goes as a copy of what it
    isn't. Columns of any name stay.
    """
    given = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tid, check = text_keys(given)
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        given.alias("text"),
        tid.alias("tid"),
        check.alias("check"),
        id_.alias("id"),
    )
    texts = stored(marked.groupBy("tid", "check").agg(F.min("id").alias("id")), "texts")
    nodes = texts.groupBy("tid").agg(F.min(F.struct("check", "id")).alias("m")).select("tid", "m.check", "m.id")
    # each text once, from the row of its first id
    roots = near_roots(marked.join(nodes, ["tid", "check", "id"], "left_semi").select("tid", "text"))
    grouped = nodes.join(roots, nodes["tid"] == roots["node"], "left").select("tid", "check", "id", F.coalesce("root", "tid").alias("root"))
    best = grouped.groupBy("root").agg(F.min(F.struct("id", "tid", "check")).alias("m")).select("m.tid", "m.check", "m.id")
    kept = best.unionByName(texts.join(nodes, ["tid", "check"], "left_anti"))
    one = Window.partitionBy("tid", "check", "id").orderBy(F.xxhash64(F.to_json("doc")))
    left = marked.drop("text").join(kept, ["tid", "check", "id"], "left_semi").withColumn("n", F.row_number().over(one))
    return left.where("n = 1").select("doc.*")
