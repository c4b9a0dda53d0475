"""Facts of sentences stand in for patterns on whole windows, and steps that two readers share run once."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentloom.functions import lexicon as lx
from momentloom.functions import text as tx
from momentloom.operators import scores, seeds
from momentloom.plans import analyze as an
from momentloom.plans.registry import SAMPLE
from momentloom.plans.stable import stable

# Closed and open sentences, phrases and counts that only a missing mark lets run over a border.
TEXTS = (
    "So this is the first one, right?", "The truth is here.", "I was 12.", "percent of them, you know, and", "when", "I left",
    "it was amazing!", "\"Back then.\"", "you need to 'stop'?'", "um", "uh. Like", "from", "That", "is what they do with the.",
    "Mr. Smith paid 1,000. It turned out fine.", "ümlaut étés 5 años!", "a few", "years ago. And", "est-ce que? Und.", "always")


def sentences(spark):
    rows = [(k, i, i * 6000, i * 6000 + 5900, TEXTS[(i * (k + 1) * 7 + k) % len(TEXTS)] + (" from 7 with love." if i % 3 == 0 else ""))
            for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "transcript_id long, idx long, start_ms long, end_ms long, text string")
    return df.withColumns({"gap_before_ms": F.lit(100).cast("long"), "block": F.lit(0).cast("long")})


def test_scores_from_facts_equal_scores_from_texts(spark):
    found = stable(an.find_candidates(sentences(spark), SAMPLE))
    assert 0 < found.where("facts is not null").count() < found.count()
    a = scores.score_candidates(found, SAMPLE)
    b = scores.score_candidates(found.drop("facts"), SAMPLE)
    assert a.columns == b.columns and "facts" not in a.columns
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_facts_of_joined_sentences(spark):
    df = spark.createDataFrame([(i, [TEXTS[(i * 3 + j * (i + 1)) % len(TEXTS)] for j in range(1 + i % 4)]) for i in range(200)], "i int, p array<string>")
    one = df.select("i", F.posexplode("p").alias("j", "text")).withColumn("f", tx.text_facts("text"))
    parts = one.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "f"))).alias("l"))
    whole = parts.join(df, "i").select(
        F.array_join("p", " ").alias("text"), tx.joined_facts(F.transform("l", lambda x: x["f"])).alias("facts")).where("facts is not null")
    assert whole.count() > 20
    assert whole.transform(tx.annotate_text).drop("facts").collect() == whole.drop("facts").transform(tx.annotate_text).collect()


def test_a_pattern_that_may_cross_a_mark_is_not_added_up():
    assert tx.separable(SAMPLE) and tx.separable(lx.DEFAULT)
    assert not tx.separable(lx.Lexicon(story=r"fine\. then"))
    assert not tx.separable(lx.Lexicon(emotion_words=("oh. no",)))


def test_endings_are_judged_by_the_last_word(spark):
    texts = ["this and", "this and.", "sand.", "x́and!?", "the", "é the...", "it is so!", "closed.'", "closed.\"", ".", "", None, "because.", "ſo."]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = tx.strip("text")
    old = ~whole.rlike(r"[.!?]['\"]?\z") | tx.matches(whole, lx.TRAILING_CONNECTIVE + r"[.!?]*\z")
    assert df.where(~tx.looks_incomplete("text").eqNullSafe(old)).count() == 0


def test_seeds_take_facts_that_are_there(spark):
    text = sentences(spark)
    facts = seeds.with_facts(text, SAMPLE)
    a, b = seeds.find_seeds(facts, SAMPLE), seeds.find_seeds(text, SAMPLE)
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
