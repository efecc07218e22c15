"""Board codec and scores as column expressions: 64 cells, a8 first, of 0 (empty) to 12.

Strings follow the public position notation: ranks from the eighth down, joined by /, digits for runs of
empty cells, piece letters in upper case for White. Arrays and strings that break a rule give null here;
strict() raises instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOLS = ".PNBRQKpnbrqk"
CELLS = 64


def placement_of(text: Column) -> Column:
    """The field before the first space."""
    return F.split(F.trim(text), " ")[0]


def flat(text: Column) -> Column:
    """The placement with digits written out as dots and ranks still apart."""
    return reduce(lambda s, k: F.regexp_replace(s, str(k), "." * k), range(1, 9), placement_of(text))


def valid(text: Column) -> Column:
    """Eight ranks of eight known symbols."""
    return F.coalesce(~placement_of(text).rlike("[09]") & flat(text).rlike(r"^[.PNBRQKpnbrqk]{8}(/[.PNBRQKpnbrqk]{8}){7}$"), F.lit(False))


def to_cells(text: Column) -> Column:
    symbols = F.split(F.regexp_replace(flat(text), "/", ""), "")
    return F.when(valid(text), F.transform(symbols, lambda c: F.instr(F.lit(SYMBOLS), c) - 1))


def strict(text: Column) -> Column:
    return F.when(valid(text), to_cells(text)).otherwise(F.raise_error(F.concat(F.lit("no position: "), F.coalesce(text, F.lit("null")))))


def to_placement(cells: Column) -> Column:
    """Placement of an array of 64 cells; null for any other array."""
    letters = F.array_join(F.transform(cells, lambda x: F.substring(F.lit(SYMBOLS), x + 1, 1)), "")
    ranks = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.substring(letters, r * 8 + 1, 8)), "/")
    packed = reduce(lambda s, k: F.regexp_replace(s, r"\." * k, str(k)), range(8, 0, -1), ranks)
    return F.when((F.size(cells) == CELLS) & F.forall(cells, lambda x: x.between(0, 12)), packed)


def to_position(cells: Column, side: Column | str = "w") -> Column:
    side = F.lit(side) if isinstance(side, str) else side
    return F.concat(to_placement(cells), F.lit(" "), side, F.lit(" - - 0 1"))


def colour(piece: Column) -> Column:
    return F.when(piece.between(1, 6), "white").when(piece.between(7, 12), "black")


def kind(piece: Column) -> Column:
    """pawn, knight, bishop, rook, queen, king; null for an empty cell."""
    names = F.array(*[F.lit(n) for n in ("pawn", "knight", "bishop", "rook", "queen", "king")])
    return F.when(piece > 0, F.get(names, (piece - 1) % 6))


def square_name(index: Column) -> Column:
    return F.concat(F.substring(F.lit("abcdefgh"), index % 8 + 1, 1), (8 - F.floor(index / 8)).cast("string"))


def square_index(name: Column) -> Column:
    """Index of a square's name; null if it is none."""
    return F.when(name.rlike("^[a-h][1-8]$"), (8 - F.substring(name, 2, 1).cast("int")) * 8 + F.ascii(name) - 97)


def light(index: Column) -> Column:
    return (index % 8 + 8 - F.floor(index / 8)) % 2 == 0


def changed(a: Column, b: Column) -> Column:
    """Indices at which two boards differ."""
    return F.filter(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: F.get(a, i) != F.get(b, i))


def _count(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda n, x: n + x.cast("int"))


def hamming(a: Column, b: Column) -> Column:
    return _count(F.zip_with(a, b, lambda x, y: x != y))


def score(pred: Column, truth: Column) -> dict[str, Column]:
    """correct, occupancy_correct, occupied and piece_correct of one board; null if either hasn't 64 cells."""
    ok = (F.size(pred) == CELLS) & (F.size(truth) == CELLS)
    return {
        "correct": F.when(ok, _count(F.zip_with(pred, truth, lambda x, y: x == y))),
        "occupancy_correct": F.when(ok, _count(F.zip_with(pred, truth, lambda x, y: (x > 0) == (y > 0)))),
        "occupied": F.when(ok, _count(F.transform(truth, lambda y: y > 0))),
        "piece_correct": F.when(ok, _count(F.zip_with(pred, truth, lambda x, y: (y > 0) & (x == y)))),
    }


def argmax(scores: Column) -> Column:
    """Index of the first greatest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def log_softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(scores, lambda x: x - top - F.log(total))


def permuted(cells: Column, table: list[int]) -> Column:
    """Cells with each class replaced through table."""
    to = F.array(*[F.lit(t) for t in table])
    return F.transform(cells, lambda x: F.get(to, x))
