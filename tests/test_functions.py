"""Column functions against hand-made rows and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions import board, text, values

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def plain_cells(placement):
    out = []
    for c in placement.replace("/", ""):
        out += [0] * int(c) if c.isdigit() else [board.SYMBOLS.index(c)]
    return out


def test_codec_round_trip(spark):
    r = random.Random(4)
    rows = [([r.choice([0, 0, 0, *range(1, 13)]) for _ in range(64)],) for _ in range(40)] + [([0] * 64,), (plain_cells(START),)]
    got = spark.createDataFrame(rows, "c array<int>").select("c", board.to_position(F.col("c")).alias("p")).select("c", "p", board.to_cells(F.col("p")).alias("back")).collect()
    assert all(g["c"] == g["back"] == plain_cells(g["p"].split()[0]) for g in got)
    assert got[-1]["p"] == START + " w - - 0 1" and got[-2]["p"].startswith("8/8/8/8/8/8/8/8 ")


@pytest.mark.parametrize("bad", ["8/8/8/8/8/8/8", "9/8/8/8/8/8/8/8", "7/8/8/8/8/8/8/8", "8/8/8/8/8/8/8/7x", "", "8/8/8/8/8/8/8/8/8", "44p/8/8/8/8/8/8/8"])
def test_codec_rejects(spark, bad):
    got = one(spark, cells=board.to_cells(F.lit(bad)), valid=board.valid(F.lit(bad)))
    assert got["cells"] is None and got["valid"] is False
    with pytest.raises(Exception, match="no position"):
        spark.range(1).select(board.strict(F.lit(bad))).collect()


def test_score(spark):
    truth = plain_cells(START)
    wrong_piece, emptied = [*truth], [*truth]
    wrong_piece[0], emptied[1] = 5, 0
    rows = [(truth, truth), (wrong_piece, truth), (emptied, truth), ([0] * 64, [0] * 64), ([0] * 63, truth)]
    df = spark.createDataFrame(rows, "p array<int>, t array<int>").select(*[c.alias(n) for n, c in board.score(F.col("p"), F.col("t")).items()], board.hamming(F.col("p"), F.col("t")).alias("h"))
    got = [tuple(r)[:4] for r in df.collect()]
    assert got == [(64, 64, 32, 32), (63, 64, 32, 31), (63, 63, 32, 31), (64, 64, 0, 0), (None,) * 4]


def test_squares(spark):
    got = one(spark, a8=board.square_index(F.lit("a8")), h1=board.square_index(F.lit("h1")), bad=board.square_index(F.lit("i1")), name=board.square_name(F.lit(63)), light=board.light(F.lit(0)), dark=board.light(F.lit(56)))
    assert (got["a8"], got["h1"], got["bad"], got["name"], got["light"], got["dark"]) == (0, 63, None, "h1", True, False)


@pytest.mark.parametrize("read, seconds", [("31:08", 1868), ("0:31:08", 1868), ("2.41", 161), ("0:47.09", 2829), ("0:00", 0), ("1 9:06", 1146), ("7:5", None), ("no clock", None), ("", None)])
def test_read_clock(spark, read, seconds):
    assert one(spark, c=text.read_clock(F.lit(read)))["c"] == seconds


def test_clock_and_control(spark):
    base, inc = text.time_control(F.lit("90+30"))
    bad, none = text.time_control(F.lit("blitz"))
    got = one(spark, c=text.comment_clock(F.lit("[%clk 1:02:03]")), n=text.comment_clock(F.lit("good")), b=base, i=inc, x=bad, y=none, s=text.show_clock(F.lit(59)), h=text.show_clock(F.lit(3661)), e=text.show_clock(F.lit(None).cast("int")))
    assert tuple(got) == (3723, None, 5400, 30, None, 0, "0:59", "1:01:01", "")


@pytest.mark.parametrize("name, key", [("Carlsen, Magnus", "carlsen"), ("Wei Yi", "wei"), ("Hou Yifan", "yifan"), ("  ", ""), ("Anna-Maria Li", "anna-maria")])
def test_surname(spark, name, key):
    assert one(spark, k=text.surname_key(F.lit(name)))["k"] == key


@pytest.mark.parametrize("name, blob, hit", [("carlsen", "m. carlsen 2830", True), ("carlsen", "arlsen", True), ("carlsen", "arls", False), ("so", "so 2770", True), ("son", "arlson x", True), ("li", "l", False), ("", "x", False), ("yi", "y i", False)])
def test_name_in(spark, name, blob, hit):
    assert one(spark, h=text.name_in(F.lit(name), F.lit(blob)))["h"] is hit


@pytest.mark.parametrize("link, found", [("https://www.youtube.com/watch?v=abcdefghijk&t=3", "abcdefghijk"), ("https://youtu.be/abcdefghijk", "abcdefghijk"), ("https://x.org/embed/abc-efg_ijk?x", "abc-efg_ijk"), ("abcdefghijk", "abcdefghijk"), ("abc", None), ("https://x.org/watch", None)])
def test_video_id(spark, link, found):
    assert one(spark, v=text.video_id(F.lit(link)))["v"] == found


def test_media_and_paths(spark):
    got = one(
        spark, png=text.media_kind(F.unhex(F.lit("89504E470D0A1A0A00"))), mp4=text.media_kind(F.unhex(F.lit("0000001866747970"))), no=text.media_kind(F.unhex(F.lit("00"))), ok=text.safe_path(F.lit("images/a.png")), up=text.safe_path(F.lit("images/..")), abs=text.safe_path(F.lit("/images/a"))
    )
    assert tuple(got) == ("png", "mp4", None, True, False, False)


def test_unit_and_band(spark):
    got = one(spark, z=text.unit(F.array(F.lit(0.0), F.lit(0.0))), u=text.unit(F.array(F.lit(3.0), F.lit(4.0))), lo=text.band(F.lit(1.0), [2.0, 5.0]), at=text.band(F.lit(2.0), [2.0, 5.0]), hi=text.band(F.lit(9.0), [2.0, 5.0]))
    assert got["z"] == [0.0, 0.0] and got["u"] == pytest.approx([0.6, 0.8]) and (got["lo"], got["at"], got["hi"]) == (0, 1, 2)


def test_values(spark):
    rect = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip("xywh", v, strict=True)])
    spec = {n: values.size_spec(F.lit(v)) for n, v in (("native", "native"), ("plain", "644"), ("zero", "0"), ("less", "-3"), ("word", "big"), ("none", None))}
    got = one(spark, **{f"{n}_{k}": c for n, two in spec.items() for k, c in zip("vs", two, strict=True)})
    assert (got["native_v"], got["native_s"], got["plain_s"]) == (True, None, 644) and not any(got[f"{n}_v"] for n in ("zero", "less", "word", "none"))
    got = one(spark, ok=values.rect_ok(rect(0, 0, 1, 1)), flat=values.rect_ok(rect(0, 0, 0, 5)), off=values.rect_ok(rect(-1, 0, 3, 5)), cut=values.clipped(rect(-2, 5, 6, 90), 10, 20), out=values.clipped(rect(40, 0, 5, 5), 10, 20))
    assert (got["ok"], got["flat"], got["off"]) == (True, False, False) and tuple(got["cut"]) == (0, 5, 4, 15) and got["out"]["w"] == 0
    board_of = lambda *c: F.array(*[F.lit(x) for x in c])
    got = one(spark, ok=values.labels_ok(board_of(*[3] * 64)), high=values.labels_ok(board_of(*[13] * 64)), few=values.labels_ok(board_of(*[3] * 63)), unit=values.direction_ok(board_of(0.6, -0.8)), long=values.direction_ok(board_of(0.6, -0.81)), nan=values.direction_ok(board_of(float("nan"), 1.0)))
    assert tuple(got) == (True, False, False, True, False, False)
    assert [tuple(r) for r in values.classes(spark).orderBy("label").collect()] == [(0, 0, 0), *[(k, (k - 1) % 6 + 1, 1 if k <= 6 else 2) for k in range(1, 13)]]
    got = one(spark, a=values.round_trip(F.lit('{"odd": 1, "kind": "x", "in": {"k": 2, "z": 3}}'), "kind string, in struct<k:int>", {"kind": ["x"]}), b=values.round_trip(F.lit('{"kind": "y"}'), "kind string, in struct<k:int>", {"kind": ["x"]}))
    assert tuple(got) == ('{"kind":"x","in":{"k":2}}', "{}")
