"""Shared session and a small spoken transcript with word timings."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SEGMENT = ("transcript_id string, seg_idx bigint, start_ms bigint, end_ms bigint, text string, "
           "words array<struct<start_ms:bigint,end_ms:bigint,text:string,prob:double>>, "
           "avg_logprob double, no_speech_prob double")
TALK = [
    (1200, "Good evening, tonight a baker tells how her ovens got through a winter without power."),
    (8100, "Well the flour had been paid for and the shop was full of people."),
    (13900, "Then the lights went out and I lost forty trays of bread in one night."),
    (20700, "The only machine still running was a hand mill from my grandmother."),
    (26200, "Why would you bake by candle light when the street is dark?"),
    (31500, "Because every loaf was promised, and nobody had told the school yet."),
    (37800, "We sold 300 loaves before sunrise, however the dough was never better."),
    (44900, "I was terrified and proud, it was the best week that bakery ever had."),
    (52300, "You need to keep one tool that works with no plug at all."),
    (58000, "My advice is to write down which orders cannot wait."),
    (63400, "Anyway the power came back on a Thursday."),
    (67100, "That is all from the bakery, mind the icy steps on your way home."),
]


def spoken(text: str, start: int, end: int) -> list[tuple]:
    tokens = text.split()
    step = (end - start - 100) / len(tokens)
    return [(round(start + i * step), round(start + i * step + 0.85 * step), t, 1.0) for i, t in enumerate(tokens)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def talk(spark):
    rows = []
    for i, (start, text) in enumerate(TALK):
        end = TALK[i + 1][0] - 200 if i + 1 < len(TALK) else start + 5000
        rows.append(("t", i, start, end, text, spoken(text, start, end), -0.3, 0.02))
    return spark.createDataFrame(rows, SEGMENT)
