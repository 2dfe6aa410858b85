from pyspark.sql import functions as F

from rookery.functions import columns as c


def one(spark, expr, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr.alias("x")).first().x


def each(spark, rows, schema, expr):
    return [r.x for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr.alias("x")).collect()]


def test_mode_of(spark):
    want = {"60": "bullet", "179": "bullet", "180": "blitz", "599": "blitz", "600+5": "rapid", "1800": "rapid", "1801": "classical", "1/86400": "daily", "": "unknown", "abc": "unknown", "-5": "unknown", " 180 ": "blitz", "120+1": "bullet", "99999999999": "unknown"}
    assert each(spark, [(k,) for k in want], "t string", c.mode_of("t")) == list(want.values())
    assert each(spark, [(None,)], "t string", c.mode_of("t")) == ["unknown"]
    assert each(spark, [("180+2",), ("60",), (None,), ("x+y",)], "t string", c.bonus_of("t")) == [2.0, 0.0, 0.0, 0.0]


def test_results(spark):
    words = ["win", "agreed", "resigned", "weird", None, " Timeout "]
    assert each(spark, [(w,) for w in words], "t string", c.points_of("t")) == [1.0, 0.5, 0.0, None, None, 0.0]
    assert each(spark, [(1.0,), (0.5,), (0.0,), (None,)], "t double", c.result_label("t")) == ["win", "draw", "loss", "unknown"]
    assert [c.result_score(x) for x in ("win", "Draw", "loss", None, "?")] == [1.0, 0.5, 0.0, 1.0, 1.0]


def test_buckets_and_sides(spark):
    want = {0: "equal", 49: "equal", -49: "equal", 50: "small", -50: "small", 149: "small", 150: "clear", 299: "clear", 300: "decisive", 8999: "decisive", 9000: "mate", -9000: "mate"}
    assert each(spark, [(float(k),) for k in want], "s double", c.advantage_bucket("s")) == list(want.values())
    assert each(spark, [(None,)], "s double", c.advantage_bucket("s")) == [None]
    assert each(spark, [(51.0,), (50.0,), (-50.0,), (-51.0,), (None,)], "s double", c.side_of("s")) == ["white", "balanced", "balanced", "black", None]


def test_bins(spark):
    got = each(spark, [(x,) for x in (0.0, 0.99, 1.0, 4.9, 40.0, 500.0)] + [(None,)], "m double", c.labelled_bin("m"))
    assert [None if g is None else tuple(g) for g in got] == [("0-1", 1), ("0-1", 1), ("1-2", 2), ("3-5", 4), ("40+", 8), ("40+", 8), None]
    assert each(spark, [(0,), (9,), (10,), (25,)], "m int", c.floor_bin("m", 10)) == [0, 0, 10, 20]


PGN = """[Event "Live"]
[UTCDate "2023.01.01"]
[Date "2024.02.03"]
[StartTime "10:00:00"]
[EndDate "2024.02.03"]
[EndTime "10:05:30"]

1. e4 {[%clk 0:02:59.9]} 1... e5 {[%clk 0:02:58]} 2. Nf3 {[%clk 2:57.5]} 2... Nc6 {[%clk 0:02:50]} 3. Bb5 {[%clk 0:02:40.25]} 1-0"""


def test_pgn(spark):
    assert one(spark, c.header("p", "Date"), p=PGN) == "2024.02.03"
    assert one(spark, c.header("p", "Missing"), p=PGN) is None
    assert str(one(spark, c.header_time("p", "Date", "StartTime"), p=PGN)) == "2024-02-03 10:00:00"
    assert one(spark, c.elapsed_seconds("p"), p=PGN) == 330.0
    assert one(spark, c.elapsed_seconds("p"), p=PGN.replace("EndTime", "Other")) == 0.0
    assert one(spark, c.header_time("p", "Date", "StartTime"), p=PGN.replace("2024.02.03", "????.??.??")) is None
    assert one(spark, c.move_tokens("p"), p=PGN) == ["e4", "e5", "Nf3", "Nc6", "Bb5"]
    assert one(spark, c.move_count("p"), p=PGN) == 3
    assert one(spark, c.move_count("p"), p='[Date "x"]\n\n*') == 0
    assert one(spark, c.clock_seconds("p"), p=PGN) == [179.9, 178.0, 177.5, 170.0, 160.25]
    assert [tuple(x) for x in one(spark, c.paired_moves(c.move_tokens("p")), p=PGN)] == [(1, "e4", "e5"), (2, "Nf3", "Nc6"), (3, "Bb5", "--")]
    assert one(spark, c.paired_moves(c.move_tokens("p")), p="") == []


FEN = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"


def test_positions(spark):
    assert one(spark, c.position_key("f"), f=FEN) == "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq -"
    assert one(spark, c.position_counter("f"), f=FEN) == "#0_1"
    assert one(spark, c.side_to_move("f"), f=FEN) == "b"
    assert one(spark, c.piece_count("f"), f=FEN) == 32
    assert len(one(spark, c.position_hash("f"), f=FEN)) == 64


def test_small_ones(spark):
    assert one(spark, c.id_from_url("u"), u="https://x/game/live/123") == 123
    assert one(spark, c.id_from_url("u"), u="https://x/game/") is None
    assert one(spark, c.canonical("u"), u="  AbC ") == "abc" and one(spark, c.canonical("u"), u="  ") is None
    assert one(spark, c.weekday(F.col("d").cast("date")), d="2024-01-07") == 0
    assert one(spark, c.day_label(F.col("d").cast("timestamp")), d="2024-01-05 01:00:00") == "2024-JAN-05"
    assert str(one(spark, c.from_epoch("s"), s=86400)) == "1970-01-02"
    assert tuple(one(spark, c.history_span(F.lit("2000-01-01").cast("date"), F.lit("2024-01-01").cast("date")))) == (8766, 20)
    assert one(spark, c.impact("n", "s"), n=3, s=-2.5) == 7.5
    assert [one(spark, c.is_real_token("t"), t=x) for x in ("e4", "--", "")] == [True, False, False]


def test_a_text_is_cut_once_not_once_for_each_move(spark):
    """Long games: the tokens of a text stand once in the plan, outside the step from move to move."""
    import time

    moves = " ".join(f"{i}. a{i} b{i}" for i in range(1, 4001))
    frame = spark.createDataFrame([(moves,)], "pgn string").select(c.paired_moves(c.move_tokens("pgn")).alias("m"))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 1
    began = time.monotonic()
    pairs = frame.first().m
    assert len(pairs) == 4000 and tuple(pairs[3999]) == (4000, "a4000", "b4000") and time.monotonic() - began < 30
    odd = spark.createDataFrame([("",), ("1. a",)], "pgn string").select(c.paired_moves(c.move_tokens("pgn")).alias("m")).collect()
    assert [[tuple(x) for x in r.m] for r in odd] == [[], [(1, "a", "--")]]
