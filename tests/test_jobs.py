from pyspark.sql import functions as F

from rookery.operators import jobs, positions


def rules():
    """A stand-in for game rules: the text counts tokens and refuses x. Nested, so that it travels by value."""

    def step(state, token):
        if token == "x":
            raise ValueError("not a move")
        state = state + [token]
        side = "wb"[len(state) % 2]
        return state, f"{''.join(sorted(state))} {side} - - {len(state)} {(len(state) + 1) // 2}"

    return step


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_generate_positions(spark):
    game = spark.createDataFrame([(1, False), (2, None), (3, True), (4, False)], "link long, fens_done boolean")
    moves = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "c", "--"), (2, 1, "b", "a"), (3, 1, "q", "q"), (4, 1, "a", "x")], "link long, n_move int, white_move string, black_move string")
    fen = spark.createDataFrame([("b b - -", 5, ["#9_9"], 1.5)], "fen string, n_games long, counters array<string>, score double")
    association = spark.createDataFrame([], "game_link long, fen_fen string, n_move int, move_color string")
    out = jobs.generate_positions(game, moves, fen, association, rules(), [])
    want = [("a b - -", 1, ["#1_1"], None), ("ab w - -", 2, ["#2_1"], None), ("abc b - -", 1, ["#3_2"], None), ("b b - -", 6, ["#1_1", "#9_9"], 1.5)]
    assert rows(out["fen"], "fen", "n_games", "counters", "score") == want
    assert rows(out["association"], "game_link", "fen_fen", "n_move", "move_color") == [(1, "a b - -", 1, "white"), (1, "ab w - -", 1, "black"), (1, "abc b - -", 2, "white"), (2, "ab w - -", 1, "black"), (2, "b b - -", 1, "white")]
    assert rows(out["game"], "link", "fens_done") == [(1, True), (2, True), (3, True), (4, True)]
    assert rows(out["failures"], "key", "step", "token") == [(4, 2, "x")]
    again = jobs.generate_positions(game, moves, out["fen"], out["association"], rules(), [])
    assert rows(again["fen"], "fen", "n_games", "counters", "score") == want and again["association"].count() == 5


def test_attach_evaluations_equals_a_refresh(spark):
    fen = spark.createDataFrame([("p1", 3, None), ("p2", 2, 60.0), ("p3", 1, None)], "fen string, n_games long, score double")
    fen = fen.withColumns({"next_moves": F.lit(None).cast("string"), "wdl_win": F.lit(None).cast("double"), "wdl_draw": F.lit(None).cast("double"), "wdl_loss": F.lit(None).cast("double")})
    association = spark.createDataFrame([(1, "p1", 1, "white"), (1, "p2", 1, "black"), (2, "p1", 1, "white"), (2, "p3", 1, "black")], "game_link long, fen_fen string, n_move int, move_color string")
    text = [("p1", True, '[{"score": -310, "pv": ["e4", "e5"], "wdl": [1, 2, 3]}, {"score": 5, "pv": ["d4"]}]'), ("p3", False, "[]")]
    evaluations = positions.read_evaluations(spark.createDataFrame(text, "fen string, is_valid boolean, analysis string"))
    continuation = spark.createDataFrame([("p1", 2, "old", 0.0), ("p2", 2, "kept", 1.0)], "fen string, rank int, move string, score double")
    gas = positions.game_analysis_summary(association, fen)
    out = jobs.attach_evaluations(fen, continuation, association, gas, evaluations)
    assert rows(out["fen"], "fen", "score", "next_moves") == [("p1", -310.0, "e4 e5"), ("p2", 60.0, None), ("p3", None, None)]
    assert rows(out["continuation"], "fen", "rank", "move") == [("p1", 2, "d4"), ("p2", 2, "kept")]
    cols = [c for c in gas.columns]
    assert rows(out["game_analysis_summary"], *cols) == rows(positions.game_analysis_summary(association, out["fen"]), *cols)
