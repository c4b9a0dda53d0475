"""Rounds of the selection compare a row with winners only, and end with the rows of the fold."""

from __future__ import annotations

import inspect

from momentloom.operators import select


def test_rounds_ship_no_tokens_with_blocks_and_equal_the_fold(spark):
    words = "oak elm ash fir yew bay box may sloe plum pear fig".split()
    rows = [(k, i * 700, i * 700 + 4000, (i * 37 + k) % 50, " ".join(words[(i * j + k) % 12] for j in range(1, 6)))
            for k in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "transcript_id long, start_ms long, end_ms long, score_overall int, text string")
    fold = select.greedy_dedup(df)
    rounds = select.greedy_dedup_any(df, unit_rows=20)
    assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, fold.collect()))
    member = inspect.getsource(select._round).split("member = ")[1].split("\n")[0]
    assert "toks" not in member
