"""A hook for recognizers: class scores of whole boards in Arrow batches, checked before and after."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import board

CELLS, CLASSES = 64, 13
#: What can be wrong with a row, in the order in which it is looked for.
MISSING, LENGTH, HOLE, INFINITE, LABELS = "no scores", "not 832 scores", "null score", "score not finite", "label out of range"


def greatest(scores: np.ndarray) -> np.ndarray:
    """The class of each cell with the greatest score, the first on a tie."""
    return scores.argmax(2)


def native_labels(scores: Column) -> Column:
    """What greatest() gives, by built-in functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda k: board.argmax(F.slice(scores, k * CLASSES + 1, CLASSES)))


def _checked(column) -> tuple[np.ndarray, np.ndarray]:
    """The scores of the sound rows of an Arrow column of lists, and of each row what is wrong with it, as a number (-1: nothing)."""
    import pyarrow.compute as pc

    size, n = CELLS * CLASSES, len(column)
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy()
    wrong = np.full(n, -1)
    wrong[lengths != size], wrong[lengths < 0] = 1, 0
    flat = column.flatten()  # lists that are null have none
    of = np.repeat(np.arange(n), np.maximum(lengths, 0))
    empty = flat.is_null().to_numpy(zero_copy_only=False)
    values = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(float)
    for mark, bad in ((3, ~np.isfinite(values)), (2, empty)):
        hit = np.unique(of[bad])
        wrong[hit[(wrong[hit] < 0) | (wrong[hit] == 3)]] = mark
    return values[wrong[of] < 0].reshape(-1, CELLS, CLASSES), wrong


def recognized(frames: DataFrame, scores: str = "scores", predict: Callable[[np.ndarray], np.ndarray] = greatest) -> DataFrame:
    """frames without its scores, with labels (64 classes) and problem; every row gives one.

    scores holds 64 times 13 numbers in a row. predict gets those of the sound rows of a batch, n x 64 x 13, and gives n x 64
    whole numbers; anything of another shape is an error. A row whose scores are null, of another length or hold a
    null or non-finite one isn't shown to predict: its labels are null and problem says why, as where predict gives
    a class that there isn't. Columns named labels or problem are replaced.
    """
    kept = [c for c in frames.columns if c not in (scores, "labels", "problem")]
    kinds = dict(frames.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in kept], "labels array<int>, problem string"])
    names = [MISSING, LENGTH, HOLE, INFINITE, LABELS]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            held, wrong = _checked(b.column(scores))
            labels = np.asarray(predict(held)) if len(held) else np.zeros((0, CELLS), int)
            if labels.shape != (len(held), CELLS) or labels.dtype.kind not in "iu":
                raise ValueError(f"{len(held)} x {CELLS} whole numbers are asked for, not {labels.dtype} of {labels.shape}")
            fit = ((labels >= 0) & (labels < CLASSES)).all(1)
            sound = np.flatnonzero(wrong < 0)
            wrong[sound[~fit]] = 4
            offsets = np.append(0, np.cumsum(np.where(wrong < 0, CELLS, 0))).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels[fit].ravel().astype(np.int32)), mask=pa.array(wrong >= 0))
            problem = pa.array([None if w < 0 else names[w] for w in wrong], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], made, problem], names=[*kept, "labels", "problem"])

    return frames.select(*[F.col(f"`{c}`") for c in [*kept, scores]]).mapInArrow(run, schema)
