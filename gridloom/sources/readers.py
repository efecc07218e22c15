"""Readers of labelled sources into one sample schema: sample_id, dataset, split, cells, image, meta."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from gridloom.functions import board
from gridloom.sources import npy

COCO = """struct<images:array<struct<id:bigint,file_name:string>>,categories:array<struct<id:int,name:string>>,
annotations:struct<pieces:array<struct<image_id:bigint,category_id:int,chessboard_position:string>>>,
splits:map<string,struct<image_ids:array<bigint>>>>"""


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a file, parsed with an explicit schema: unknown keys are dropped, missing ones null."""
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def annotated_boards(spark: SparkSession, path: str, split: str, piece_of: dict[int, int]) -> DataFrame:
    """Boards of one split of a file of images, categories, pieces and splits.

    The split is chosen before anything is joined. Every image of it gives a board, without pieces too; of two
    pieces on one square the later counts; categories outside piece_of are empty.
    """
    d = _documents(spark, path, COCO)
    ids = d.select(F.explode(F.get(F.map_values(F.map_filter("splits", lambda k, v: k == split)), F.lit(0))["image_ids"]).alias("id"))
    images = d.select(F.explode("images").alias("i")).select("i.id", F.col("i.file_name").alias("image")).join(ids, "id", "left_semi")
    classes = F.create_map(*[F.lit(x) for kv in piece_of.items() for x in kv]) if piece_of else F.create_map().cast("map<int,int>")
    pieces = (
        d.select(F.posexplode("annotations.pieces").alias("pos", "p"))
        .select(
            "pos",
            F.col("p.image_id").alias("id"),
            board.square_index(F.col("p.chessboard_position")).alias("cell"),
            F.try_element_at(classes, F.col("p.category_id")).alias("piece"),
        )
    )
    last = (
        pieces.join(ids, "id", "left_semi")
        .where("cell is not null and piece is not null")
        .groupBy("id", "cell")
        .agg(F.max_by("piece", "pos").alias("piece"))
    )
    held = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "piece"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0)))
    return (
        images.join(held, "id", "left")
        .select(
            F.col("id").cast("string").alias("sample_id"),
            F.lit(split).alias("split"),
            "image",
            F.when(F.col("m").isNull(), F.array_repeat(F.lit(0), 64)).otherwise(cells).alias("cells"),
        )
    )


def split_directories(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """root/<split>/*.json, one label a file, with split, sample_id and the image beside it, from the path."""
    d = (
        spark.read.text(f"{root}/*/*.json", wholetext=True)
        .select(F.from_json("value", schema).alias("d"), F.col("_metadata.file_path").alias("path"))
    )
    return d.select(
        "d.*",
        F.regexp_extract("path", r"/([^/]+)/[^/]+\.json$", 1).alias("split"),
        F.regexp_extract("path", r"/([^/]+)\.json$", 1).alias("sample_id"),
        F.regexp_replace("path", r"\.json$", ".png").alias("image"),
    )


def manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """samples[] of a manifest; the id falls back to the stem of the image."""
    s = (
        _documents(
            spark,
            path,
            "samples array<struct<id:string,image:string,gt_fen:string,split:string,video_id:string,game_id:string,ply:int>>",
        )
        .select(F.inline("samples"))
    )
    s = s if split is None else s.where(F.col("split") == split)
    return s.select(
        F.coalesce("id", F.regexp_extract("image", r"([^/]+?)(\.[^./]*)?$", 1)).alias("sample_id"),
        "image",
        "split",
        board.to_cells(F.col("gt_fen")).alias("cells"),
        "video_id",
        "game_id",
        "ply",
    )


def label_list(spark: SparkSession, path: str, viewpoints: DataFrame | None = None) -> DataFrame:
    """A list of image and gt_fen, with the viewpoint of each image where one is known."""
    s = (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.from_json("value", "array<struct<image:string,gt_fen:string>>")).alias("s"))
        .select("s.image", board.to_cells(F.col("s.gt_fen")).alias("cells"))
    )
    return s.withColumn("viewpoint", F.lit(None).cast("string")) if viewpoints is None else s.join(viewpoints.select("image", "viewpoint"), "image", "left")


def first_there(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, by the file system that Spark reads it with."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"))
        .select("r.*")
    )


def append_log(spark: SparkSession, path: str, schema: str, key: str, sequence: str) -> tuple[DataFrame, DataFrame]:
    """The last record of each key by its sequence number, and the number of torn lines."""
    fields = T.StructType.fromDDL(schema).add("_torn", T.StringType())
    read = (
        spark.read.text(path)
        .where(F.trim("value") != "")
        .select(F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}).alias("r"))
        .select("r.*")
    )
    w = Window.partitionBy(key).orderBy(F.desc(sequence))
    good = read.where(F.col("_torn").isNull() & F.col(key).isNotNull()).drop("_torn")
    return good.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k"), read.agg(F.count_if(F.col("_torn").isNotNull() | F.col(key).isNull()).alias("torn"))


def cached_vectors(spark: SparkSession, path: str, vector: str, width: int) -> DataFrame | None:
    """Cached vectors, or None, and so to be made anew, if there are none or one has another width.

    A path that ends in .npy is one array of numpy, whose header tells the width before any row is read.
    """
    if path.endswith(".npy"):
        return npy.vectors(spark, path, width, vector)
    found = tolerant(spark, path, None)
    if found is None or vector not in found.columns or found.where((F.size(vector) != width) | F.col(vector).isNull()).limit(1).count():
        return None
    return found


def tolerant(spark: SparkSession, path: str, schema: str | None) -> DataFrame | None:
    """The table at path; where none is, an empty one of schema, or None without a schema."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None if schema is None else spark.createDataFrame([], schema)


def video_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries keyed by id; a single tournament of old files becomes a list of one."""
    entry = "struct<title:string,date:string,tournament:string,tournaments:array<string>,round_ids:array<string>>"
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("id", "v"))
    return m.select(
        "id",
        "v.title",
        "v.date",
        F.coalesce("v.tournaments", F.when(F.col("v.tournament").isNotNull(), F.array("v.tournament"))).alias("tournaments"),
        "v.round_ids",
    )


def artifacts(spark: SparkSession, root: str, kinds: dict[str, str]) -> DataFrame:
    """video and, for each kind, whether root/<video>/ has a file whose name fits its pattern; contents aren't read."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name, video = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return paths.groupBy(video.alias("video")).agg(*[F.bool_or(name.rlike(p)).alias(k) for k, p in kinds.items()])


EVENT = "[Event "


def game_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, game_no (from 0) and g, the text of every game of files of game text; a game begins with a line [Event.

    Games are Spark's records, told apart by that line, so a large file is read by many tasks. A first pass counts the
    games of each block that a task reads, a second numbers them from there: one row a block is shuffled, no text. What
    comes before a file's first game is one by itself unless it is blank.
    """
    read = (
        spark.read.text(path, lineSep=f"\n{EVENT}")
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    )
    counts = read.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min_by(~F.col("value").rlike(r"\S"), "at").alias("blank"))
    blank = ((F.col("block") == 0) & F.col("blank")).cast("long")
    games_of = F.col("n") - blank
    before = F.sum(games_of).over(Window.partitionBy("path").orderBy("block")) - games_of - blank
    blocks = counts.select("path", "block", "first", before.alias("before"))
    met = read.join(blocks, ["path", "block"])
    g = F.when((F.col("at") == F.col("first")) & (F.col("block") == 0), F.col("value")).otherwise(F.concat(F.lit(EVENT), "value"))
    return met.select("path", (F.col("before") + F.col("at") - F.col("first")).cast("int").alias("game_no"), g.alias("g")).where(F.col("g").rlike(r"\S"))


def games(spark: SparkSession, path: str) -> DataFrame:
    """path, game_no, headers and moves (ply, san, clock in seconds) of every game of files of game text.

    A game begins with an [Event line. Comments other than clocks, variations, move numbers, glyphs and results
    are left out. Moves are as written: positions are replayed by whoever needs them.
    """
    return moves_of(game_texts(spark, path))


def moves_of(text: DataFrame) -> DataFrame:
    """headers and moves of the game text g, beside path and game_no."""
    keys, values = F.regexp_extract_all("g", F.lit(r'(?m)^\[(\w+) "((?:[^"\\]|\\.)*)"\]'), F.lit(1)), F.regexp_extract_all("g", F.lit(r'(?m)^\[(\w+) "((?:[^"\\]|\\.)*)"\]'), F.lit(2))
    body = F.regexp_replace(F.regexp_replace("g", r'(?m)^\[\w+ "(?:[^"\\]|\\.)*"\]', " "), r"\([^()]*\)", " ")
    marks = F.regexp_extract_all(body, F.lit(r"(?s)\{[^}]*\}|[^\s{}]+"), F.lit(0))
    kept = F.filter(
        F.transform(marks, lambda m: F.when(m.startswith("{"), m).otherwise(F.regexp_replace(m, r"^\d+\.+|[!?]+$", ""))),
        lambda m: (m != "") & ~m.rlike(r"^(\$\d+|1-0|0-1|1/2-1/2|\*)$"),
    )

    def step(acc, m):
        clock = F.regexp_extract(m, r"%clk\s+(\d+):(\d\d):(\d\d)", 0)
        seconds = F.regexp_extract(m, r"%clk\s+(\d+):(\d\d):(\d\d)", 1).try_cast("int") * 3600 + F.regexp_extract(m, r"%clk\s+(\d+):(\d\d):(\d\d)", 2).try_cast("int") * 60 + F.regexp_extract(m, r"%clk\s+(\d+):(\d\d):(\d\d)", 3).try_cast("int")
        last = F.get(acc, F.size(acc) - 1)
        timed = F.array_append(F.slice(acc, 1, F.size(acc) - 1), F.struct(last["san"].alias("san"), seconds.alias("clock")))
        return (
            F.when(~m.startswith("{"), F.array_append(acc, F.struct(m.alias("san"), F.lit(None).cast("int").alias("clock"))))
            .when((clock != "") & (F.size(acc) > 0), timed)
            .otherwise(acc)
        )

    moves = F.aggregate(kept, F.array().cast("array<struct<san:string,clock:int>>"), step)
    plies = F.transform(moves, lambda m, i: F.struct((i + 1).alias("ply"), m["san"].alias("san"), m["clock"].alias("clock")))
    return text.select("path", "game_no", F.map_from_arrays(keys, values).alias("headers"), plies.alias("moves"))


class Registry:
    """Names of datasets and the functions that give their frames."""

    def __init__(self):
        self._made: dict[str, Callable[..., DataFrame]] = {}

    def add(self, name: str) -> Callable:
        def put(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            if name in self._made:
                raise ValueError(f"{name} is there already")
            self._made[name] = function
            return function

        return put

    def names(self) -> list[str]:
        return sorted(self._made)

    def load(self, name: str, *args, **kwargs) -> DataFrame:
        if name not in self._made:
            raise KeyError(f"unknown dataset {name}; there are {', '.join(self.names())}")
        return self._made[name](*args, **kwargs)
