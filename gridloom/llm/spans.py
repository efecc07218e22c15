"""Positions of regular expressions in code points, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches whose places are summed up together.
BLOCK = 1024
SPAN = "struct<start:int,rank:int,end:int,kind:string,body:string>"


def find(text: Column, pattern: str, kind: str, rank: int, keep, group: int = 0) -> Column:
    """Leftmost non-overlapping matches of pattern for which keep(group's text) holds, as an array of SPAN.

    The pieces between the matches and the matches themselves alternate, so their running lengths are the
    positions; they are summed up block by block, so a text with a million matches takes no square of them. body is
    the text of the group. Texts without a match cost one search.
    """
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    body = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), body.alias("body"))
    size = lambda p: F.length(p["gap"]) + F.coalesce(F.length(p["whole"]), F.lit(0))

    def walked(block: Column, at: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + F.length(p["gap"])
            span = F.struct(
                start.alias("start"),
                F.lit(rank).alias("rank"),
                (start + F.length(p["whole"])).alias("end"),
                F.lit(kind).alias("kind"),
                p["body"].alias("body"),
            )
            found = F.when(p["whole"].isNotNull() & keep(p["body"]), F.array_append(acc["found"], span)).otherwise(acc["found"])
            return F.struct((acc["at"] + size(p)).alias("at"), found.alias("found"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"])

    def in_blocks(all_: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")),
            lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK)),
        )

    def summed(blocks: Column) -> Column:
        return F.aggregate(
            blocks,
            F.array(F.lit(0)),
            lambda acc,
            b: F.array_append(acc, F.element_at(acc, -1) + F.aggregate(b, F.lit(0), lambda n, p: n + size(p))),
        )

    def joined(blocks: Column) -> Column:
        return F.element_at(
            F.transform(F.array(summed(blocks)), lambda at: F.flatten(F.transform(blocks, lambda b, i: walked(b, F.get(at, i))))),
            1,
        )

    # each array is bound once, by a transform over an array of one
    bound = F.transform(F.transform(F.array(parts), in_blocks), joined)
    return F.when(text.rlike(pattern), F.element_at(bound, 1)).otherwise(none)


def ordered(spans: Column) -> Column:
    return F.array_sort(spans)


def written(spans: Column) -> Column:
    """kind:start:end of spans already in order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def clear_of(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
