"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text.

A window is a word in lower case without its punctuation. Held between two copies of a carrier that ends both
dictionaries, so that even four letters can be matched, it is compressed with either; the difference of the
two lengths in bytes is its distance. A text's counts of windows beyond each distance go through thresholds
calibrated by logistic regression. Windows that both kinds of text share say nothing, so each dictionary is
trained on the windows that its own kind has more often. Windows of several words were measured too and do far
worse where toxic words stand alone in ordinary prose: what an eight-word window saves by one word is less than
what chance matches in the other seven save (figures in README.md).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, importable, stored, table

#: The models are fitted on so many labelled documents of each kind at most, those of the least id hashes.
MOST_TOXIC, MOST_ORDINARY = 2000, 3000
DICTIONARY, LEVEL, REMEMBERED = 8192, 9, 150_000
CARRIER = b"0123456789ABCDEF~" * 2
#: A window belongs to toxic text if at least so many texts have it, so many times as often; to ordinary text up to the last.
LEAST_TEXTS, TOXIC_ODDS, ORDINARY_ODDS = 3, 3.0, 1.5
DISTANCES = range(1, 9)
#: Characters of the longest window that a dictionary may have.
LONGEST = 64


def windows(text: str | None) -> list[str]:
    return [w.strip(".,!?*#%$&|()").lower() for w in (text or "").split()]


def _window_bytes(window: str) -> bytes:
    return b" " + window.encode("utf-8", "surrogatepass") + b" "


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def distance(self, window: str) -> int:
        """Bytes that the toxic dictionary saves over the ordinary one."""
        import zstandard as z

        if self._ready is None:
            params = z.ZstdCompressionParameters.from_level(
                LEVEL,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
                format=z.FORMAT_ZSTD1_MAGICLESS,
            )
            by = lambda d: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=params)
            self._ready = by(self.ordinary), by(self.toxic), {}
        ordinary, toxic, known = self._ready
        out = known.get(window)
        if out is None:
            if len(known) > REMEMBERED:
                known.clear()
            held = CARRIER + _window_bytes(window) + CARRIER
            out = known[window] = len(ordinary.compress(held)) - len(toxic.compress(held))
        return out

    def features(self, text: str | None) -> list[float]:
        found = np.array([self.distance(w) for w in windows(text)], np.int64)
        n = max(1, len(found))
        beyond = [int((found >= k).sum()) for k in DISTANCES]
        return [*[math.log1p(b) for b in beyond], *[math.sqrt(b / n) for b in beyond], math.log(n), float(found.mean()) if len(found) else 0.0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Likelihood of label 1, 0 to 1."""
        x = (np.array([self.features(t) for t in texts]).reshape(len(texts), len(self.mean)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weight[:-1] + self.weight[-1], -30, 30)))


def _dictionary(chosen: list[str]) -> bytes:
    """The windows, first ones last and so nearest to what is compressed, then the carrier."""
    held, size = [], 0
    for w in chosen:
        size += len(_window_bytes(w)) - 1
        if size > DICTIONARY:
            break
        held.append(_window_bytes(w)[:-1])
    return b"".join(reversed(held)) + b" " + CARRIER


def calibrated(model: Model, x: np.ndarray, y: np.ndarray, stands_for: tuple[float, float] = (1.0, 1.0)) -> Model:
    """model with thresholds from the features x and labels y; with one label only, the share of that label is every score.

    A row of label 0 or 1 weighs as many as it stands_for, so scores are likelihoods at the labels' own shares however
    the sample was taken.
    """
    n = [len(y) - int(y.sum()), int(y.sum())]
    if min(n) == 0:
        model.weight[-1] = math.log((n[1] + 0.5) / (n[0] + 9.5))
        return model
    weight = np.where(y == 1, stands_for[1], stands_for[0])
    model.mean = np.average(x, 0, weight)
    model.scale = np.sqrt(np.average((x - model.mean) ** 2, 0, weight)) + 1e-9
    z = np.hstack([(x - model.mean) / model.scale, np.ones((len(x), 1))])
    ridge = np.diag([0.1] * x.shape[1] + [1e-6])
    for _ in range(50):  # Newton's steps
        p = 1 / (1 + np.exp(-np.clip(z @ model.weight, -30, 30)))
        model.weight = model.weight - np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(ridge)), z.T @ (weight * (p - y)) + ridge @ model.weight)
    return model


def _seen(sample: DataFrame) -> DataFrame:
    """window, and how many toxic and ordinary texts of sample have it."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for t, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = sorted({w for w in windows(t) if 0 < len(w) <= LONGEST})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.string()), pa.array([label] * len(own), pa.int32())],
                    names=["window", "toxic"],
                )

    each = sample.select("text", "toxic").mapInArrow(run, "window string, toxic int")
    return each.groupBy("window").agg(F.sum("toxic").alias("in_toxic"), F.sum(1 - F.col("toxic")).alias("in_ordinary"))


def _chosen(seen: DataFrame, n: dict[int, int], label: int) -> list[str]:
    """The windows of one dictionary, most frequent first; no more than it has room for reach the driver."""
    odds = (F.col("in_toxic") + 0.5) / (n.get(1, 0) + 1) / ((F.col("in_ordinary") + 0.5) / (n.get(0, 0) + 1))
    k, fits = (F.col("in_toxic"), odds >= TOXIC_ODDS) if label else (F.col("in_ordinary"), odds <= ORDINARY_ODDS)
    rows = seen.where((k >= LEAST_TEXTS) & fits).orderBy(k.desc(), "window").select("window").limit(DICTIONARY // 2).collect()
    return [r["window"] for r in rows]


def held_out(doc_id: str) -> Column:
    """Rows that no model learns from: crc32 of the id as text divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_ordinary: int = MOST_ORDINARY) -> Model:
    """A model from the documents that labels marks, those held out apart.

    The sample has most_toxic and most_ordinary rows at most, those of the least id hashes; each row of a class weighs
    as many as the class has in all over its sample. No text reaches the driver: it gets the two dictionaries' windows
    and the sample's features. Of several labels of one id the largest counts; null labels and ids don't; of several
    texts of one id the least. Empty tables give a model that scores every text alike.
    """
    import pyarrow as pa

    importable(docs.sparkSession)
    marked = (
        labels.where("doc_id is not null and toxic is not null")
        .where(~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    some = lambda toxic, most: marked.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = some(1, most_toxic).union(some(0, most_ordinary))
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    sample = stored(own.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")), "labelled")
    n = dict(sample.groupBy("toxic").count().collect())
    seen = stored(_seen(sample), "windows")
    blank = np.zeros(2 * len(DISTANCES) + 2)
    model = Model(_dictionary(_chosen(seen, n, 1)), _dictionary(_chosen(seen, n, 0)), blank, blank + 1, np.zeros(len(blank) + 1))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            x = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("toxic"), pa.array(x, pa.list_(pa.float64()))],
                names=["doc_id", "toxic", "x"],
            )

    rows = sample.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id string, toxic int, x array<double>").collect()
    rows.sort(key=lambda r: r["doc_id"])
    total = dict(marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("toxic").count().collect())
    stands_for = tuple(max(1.0, total.get(k, 0) / max(1, n.get(k, 0))) for k in (0, 1))  # labels without a document stand in neither
    return calibrated(
        model,
        np.array([r["x"] for r in rows]).reshape(len(rows), len(blank)),
        np.array([r["toxic"] for r in rows], float),
        stands_for,
    )


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a score of this name. Null and empty texts have one too, that of no windows; every row gives one row.

    A column of that name, in any case, is replaced; others stay, whatever their names.
    """
    import pyarrow as pa

    importable(docs.sparkSession)
    own = docs.drop(name)
    schema = ", ".join([*[f"`{n}` {t}" for n, t in own.dtypes], f"`{name}` double"])

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                values = pa.array(model.scores(some.column(some.schema.names.index("text")).to_pylist()), pa.float64())
                yield pa.RecordBatch.from_arrays([*some.columns, values], names=[*some.schema.names, name])

    return own.mapInArrow(run, schema)


def keep_ordinary(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs with a score below threshold, as they were, whatever their columns."""
    name = "score"
    while name in map(str.lower, docs.columns):
        name = f"_{name}"
    return score(docs, train(docs, labels), name).where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; null and empty texts score as no windows do."""
    docs = documents(spark, sf_dir)
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
