"""Clocks, names, ids and links as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def comment_clock(comment: Column) -> Column:
    """Seconds of a %clk H:MM:SS mark, else null."""
    part = lambda k: F.regexp_extract(comment, r"%clk\s+(\d+):(\d\d):(\d\d)", k).try_cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def time_control(text: Column) -> tuple[Column, Column]:
    """Base in seconds (given in minutes) and increment in seconds of base+inc; anything else: null and 0."""
    pattern = r"^(\d+)\+(\d+)$"
    base, inc = (F.regexp_extract(text, pattern, k).try_cast("int") for k in (1, 2))
    return base * 60, F.coalesce(inc, F.lit(0))


def read_clock(text: Column) -> Column:
    """Seconds of the first M:SS or H:MM:SS (or with .) in recognised text, spaces ignored; else null."""
    found = F.regexp_extract(F.regexp_replace(text, " ", ""), r"\d{1,2}[:.]\d{2}([:.]\d{2})?", 0)
    parts = F.transform(F.split(found, "[:.]"), lambda p: p.try_cast("int"))
    return F.when(found != "", F.aggregate(parts, F.lit(0), lambda a, p: a * 60 + p))


def show_clock(seconds: Column) -> Column:
    """M:SS, past an hour H:MM:SS; null: empty."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(seconds.isNull(), "").when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def surname_key(name: Column) -> Column:
    """What stands before a comma; without one the first of the longest words; in lower case."""
    words = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    longest = F.aggregate(words, F.lit(""), lambda a, w: F.when(F.length(w) > F.length(a), w).otherwise(a))
    return F.lower(F.when(F.contains(name, F.lit(",")), F.trim(F.split(name, ",")[0])).otherwise(longest))


def name_in(name: Column, blob: Column, gap: int = 2, least: int = 4) -> Column:
    """Whether a name is read in a blob: as a part of it, or one of its words holds the other within gap letters.

    If the shorter of the two has fewer than least letters, they must be equal.
    """

    def near(word: Column) -> Column:
        short, long = F.least(F.length(word), F.length(name)), F.greatest(F.length(word), F.length(name))
        held = F.contains(word, name) | F.contains(name, word)
        return F.when(short < least, word == name).otherwise(held & (long - short <= gap))

    words = F.filter(F.split(blob, r"\s+"), lambda w: w != "")
    return F.coalesce((name != "") & (F.contains(blob, name) | F.exists(words, near)), F.lit(False))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), " ", "")


def alnum_upper(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def video_id(text: Column) -> Column:
    """The 11-character id of four URL forms or of a bare id; else null."""
    forms = F.regexp_extract(text, r"(?:[?&]v=|youtu\.be/|/embed/|/shorts/)([A-Za-z0-9_-]{11})(?![A-Za-z0-9_-])", 1)
    return F.coalesce(F.nullif(forms, F.lit("")), F.when(text.rlike("^[A-Za-z0-9_-]{11}$"), text))


def seek_link(url: Column, seconds: Column) -> Column:
    return F.concat(url, F.when(F.contains(url, F.lit("?")), "&t=").otherwise("?t="), F.floor(seconds).cast("string"), F.lit("s"))


def custom_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False))


def safe_path(path: Column) -> Column:
    """Relative, without .. and below images/ only."""
    return F.coalesce(path.rlike("^images/[^/]+$") & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def dashed_date(text: Column) -> Column:
    """YYYYMMDD with dashes, else empty."""
    return (
        F.when(text.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))
        .otherwise("")
    )


#: First bytes of media files, in hex, and their kinds.
SIGNATURES = [("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff")]


def media_kind(content: Column) -> Column:
    """Kind of a binary by its first bytes; ftyp at the fifth is mp4; else null."""
    head = F.hex(F.substring(content, 1, 16))
    kind = F.when(F.substring(head, 9, 8) == "66747970", "mp4")
    for mark, name in SIGNATURES:
        kind = kind.when(head.startswith(mark), name)
    return kind


def slug(dataset: Column, split: Column) -> Column:
    return F.concat_ws("_", dataset, F.coalesce(split, F.lit("all")))


def cost(tokens: dict[str, Column], price: dict[str, Column], batch: Column) -> Column:
    """Price of input, output and cached tokens per million; half in a batch. Reasoning tokens are part of output."""
    total = sum((tokens[k] * price[k] for k in ("input", "output", "cached")), F.lit(0.0)) / 1e6
    return total * F.when(batch, 0.5).otherwise(1.0)


def learning_rate(step: Column, start: int, warm: int, total: int, peak: float, floor: float) -> Column:
    """0 before start, then linear to peak, then a half cosine down to floor."""
    done = F.least(F.greatest((step - start - warm) / F.lit(float(max(1, total - start - warm))), F.lit(0.0)), F.lit(1.0))
    return (
        F.when(step < start, 0.0)
        .when(step < start + warm, (step - start + 1) * peak / warm)
        .otherwise(floor + (peak - floor) * 0.5 * (1 + F.cos(done * F.pi())))
    )


def unit(vector: Column) -> Column:
    """Vector over its length plus 1e-9; a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))) + 1e-9
    return F.transform(vector, lambda x: x / norm)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def band(value: Column, cuts: list[float]) -> Column:
    """Number of cuts at or below value: a value equal to a cut goes up."""
    return sum(((value >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
