"""What a step wrote on the way does not stay on disk, and texts and words travel last."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from momentloom.operators import boundaries, select
from momentloom.plans import registry, stable as st


def folders(spark) -> set[Path]:
    at = Path(st.shared_dir(spark).removeprefix("file://")) / "momentloom"
    return set(at.iterdir()) if at.exists() else set()


def shuffle_files(spark) -> int:
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum("shuffle" in found.apply(i).getName() for i in range(found.size()))


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    """Documents of some lines, with a null and a repeated key among them."""
    words = "from the oven with a loaf that is warm at dawn for the street und mit est pour des gens this was".split()
    def text(k):
        return "\n".join(" ".join(words[(i * 7 + j * (k + 1)) % len(words)] for j in range(6 + (i + k) % 9)).capitalize() + ".!?"[i % 3] for i in range(30))
    rows = [(k, text(k), "en", "web", 1) for k in range(6)] + [(None, text(9), "en", "web", 1), (5, text(5), "en", "web", 1)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{at}/documents.parquet")
    return str(at)


def test_a_stable_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    st.stable(spark.range(5000).groupBy(F.col("id") % 997).count())
    assert shuffle_files(spark) <= before
    assert not spark.conf.get(st.CLEANUP, "false") == "true"


def test_settled_keeps_its_result_only(spark):
    before = folders(spark)
    out = st.settled(spark, lambda: st.stable(st.stable(spark.range(9)).where("id > 2")))
    assert len(folders(spark) - before) == 1 and out.count() == 6
    st.drop(out)
    assert folders(spark) == before


def test_the_chain_keeps_the_tables_that_are_read(spark, corpus):
    before = folders(spark)
    rows = registry.QUERIES["refine_boundaries"](spark, corpus)
    assert rows.count() > 0 and len(folders(spark) - before) == 1
    text, best = registry.chosen(spark, corpus)
    assert len(folders(spark) - before) == 3
    assert "text" not in best.columns and "text" in text.columns


@pytest.mark.parametrize("rows", [50_000, 3])
def test_units_need_no_table_of_tokens(spark, corpus, rows, monkeypatch):
    found = registry.candidates(spark, corpus)
    fold = sorted(map(tuple, select.greedy_dedup(found, order=("seed_rank", "target_ord")).select(*registry.KEPT_COLS).collect()))
    if rows == 50_000:
        monkeypatch.setattr(select, "_with_blocks", None)
    any_size = select.greedy_dedup_any(found, order=("seed_rank", "target_ord"), unit_rows=rows).select(*registry.KEPT_COLS)
    assert fold and sorted(map(tuple, any_size.collect())) == fold


def test_units_of_rows_without_times_or_tokens(spark):
    rows = [("a", 0, 9000, 5, "one two three"), ("a", 0, 9000, 4, "one two three"), ("a", None, 9000, 3, "one two three"),
            ("a", 90_000, 99_000, 2, None), ("a", 190_000, 199_000, 1, "..."), ("b", 0, 9000, 1, "one two three"), (None, 0, 1, 1, "x")]
    df = spark.createDataFrame(rows, "transcript_id string, start_ms long, end_ms long, score_overall int, text string")
    kept = select._kept_in_order(select._ranked(df, "transcript_id", "score_overall", ("start_ms", "end_ms")).withColumn("unit", F.lit(0).cast("long")),
                                 "transcript_id", (0.45, 0.6), 10_000)
    assert sorted((r[0] or "", -r["place"]["neg"]) for r in kept.collect()) == [("", 1), ("a", 1), ("a", 2), ("a", 3), ("a", 5), ("b", 1)]


def test_covering_sentences_carries_columns(spark):
    clips = spark.createDataFrame([("t", "c", 0, 5000), ("t", "d", 90_000, 95_000)], "transcript_id string, clip_id string, start_ms long, end_ms long")
    text = spark.createDataFrame([("t", 0, 0, 3000, True), ("t", 1, 3000, 6000, False)], "transcript_id string, idx long, start_ms long, end_ms long, awk boolean")
    got = boundaries.covering_sentences(clips, text, carry=["awk"])
    assert sorted(map(tuple, got.select("clip_id", "idx", "awk").collect())) == [("c", 0, True), ("c", 1, False), ("d", 1, False)]
