import random
import re

from pyspark.sql import functions as F

from momentloom.functions import lexicon as lx
from momentloom.functions import naming
from momentloom.functions import text as tx
from momentloom.operators import hooks, keywords, segment
from momentloom.sources import sinks


def one(spark, text, *cols):
    return spark.createDataFrame([(text,)], "t string").select(*cols).first()


def test_sentences(spark):
    cases = {
        "Rain fell. Was it cold? Very cold!": ["Rain fell.", "Was it cold?", "Very cold!"],
        "We asked Prof. Oduya on Friday. She laughed.": ["We asked Prof. Oduya on Friday.", "She laughed."],
        "At 9 a.m. it opens... Then i.e. chaos. Yes. No. Maybe.": ["At 9 a.m. it opens...", "Then i.e. chaos.", "Yes.", "No. Maybe."],
        "\t open end ": ["open end"],
        "": [],
        "Ärger pur. Œuvre finie!": ["Ärger pur.", "Œuvre finie!"],
        "Wait?! What... (see Fig. 3) ok!": ["Wait?!", "What...", "(see Fig. 3) ok!"],
        "Bread etc.. was sold. Mr. Dr. Ito came": ["Bread etc..", "was sold.", "Mr. Dr. Ito came"],
        "ends with vs.": ["ends with vs."],
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    for t, got in df.select("t", tx.sentences("t")).collect():
        assert got == cases[t], t


def test_sentence_split_properties(spark):
    """Nothing is lost, pieces end at end marks, and a lone stop after an abbreviation never splits."""
    rng = random.Random(21)
    bits = ["Prof.", "vol.", "i.e.", "U.K.", "stone", "close.", "really?!", "...", "y.vol.", "Inc.", "(etc.", "b", "yes!", "co..", "Mrs. St.", "\n", "\t"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(800)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tx.sentences("t")).collect()
    squeeze = lambda t: re.sub(r"\s+", "", t)
    for i, pieces in got:
        assert "".join(map(squeeze, pieces)) == squeeze(texts[i])
        for piece in pieces:
            assert piece == piece.strip() != ""
        for piece in pieces[:-1]:
            assert piece[-1] in ".!?"
            word = re.search(r"([A-Za-z.]*?)\.$", piece)
            assert piece.endswith("..") or not word or word[1].lower().split("(")[-1] not in lx.ABBREVIATIONS


def test_offsets_round_trip(spark):
    text = "  One two three.  Four five six. Dr. No said hi!\nLast"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    rows = segment.explode_sentences(df, key=["id"], offsets=True).collect()
    assert len(rows) == 4
    for r in rows:
        assert text.strip()[r.start_char:r.end_char] == r.sentence


def test_spans_mend_sentences(spark):
    pick = random.Random(8)
    bits = ["Dr.", "No.", "e.g.", "tea!", "why?", "end.", "...", " ", "  ", "\n", "\u2003", "kettle", "\U0001f600", "a.b", "?!", "\x1c"]
    texts = ["".join(pick.choice(bits) + pick.choice(["", " "]) for _ in range(n)) for n in (1, 3, 9, 40, 200, 900)]
    texts += ["", "   ", None, "x" * 500, "x." + " " * 300 + "y", "Mr. " * 60]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "id int, text string, note string").repartition(3)
    order = lambda rows: sorted(tuple(r) for r in rows.select("id", "pos", "sentence", "start_char", "end_char").collect())
    want = order(segment.explode_sentences(df, key=["id"], offsets=True))
    assert len(want) > 200
    for span in (tx.SENTENCE_REACH, 17, 64, 1 << 16):
        got = segment.spread_sentences(df, key=["id"], span=span)
        assert order(got) == want
        assert {r.note for r in got.collect()} == {"kept"}
    nameless = spark.createDataFrame([(None, "One tea. Two teas. " * 9)], "id int, text string")
    assert segment.spread_sentences(nameless, key=["id"], span=16).count() == 18


def test_openers_and_endings(spark):
    df = spark.createDataFrame([
        ("But the kettle boiled over.",), ("A copper kettle never rusts.",), ("Okay",), ("Well, tea is ready.",),
        ("they poured six cups or",), ("Nobody knew the way to.",), ('She wrote "enough."',), ("",)], "t string")
    got = [tuple(r) for r in df.select(
        tx.starts_awkwardly("t"), tx.strip_leading_filler("t"), tx.looks_incomplete("t")).collect()]
    assert [g[0] for g in got] == [True, False, True, True, False, False, False, False]
    assert got[2][1] == "Okay" and got[3][1] == "tea is ready."
    assert [g[2] for g in got] == [False, False, True, False, True, True, False, True]


def test_flags_and_counts(spark):
    text = "I learned the only rule in 40 days at sea."
    flags = one(spark, text, *[c.alias(n) for n, c in tx.feature_flags("t").items()])
    assert flags.strong_claim and flags.number and flags.story and not flags.question
    r = one(spark, "hmm erm literally i mean kind of", tx.filler_ratio("t"), tx.word_count("t"))
    assert r[0] > 0.4 and r[1] == 7
    assert one(spark, "für sich", tx.word_count("t"))[0] == 3
    assert not one(spark, "ßand", tx.matches("t", r"\band\b"))[0]
    assert one(spark, "best-of", tx.has_any_token("t", ("best",)))[0]
    assert not one(spark, "best's", tx.has_any_token("t", ("best",)))[0]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "retention retention product product product ads with zebra zebras")], "id int, text string")
    got = [r.keyword for r in keywords.top_keywords(df, "id").orderBy("rank").collect()]
    assert got == ["product", "retention", "zebras", "zebra"]


def test_names(spark):
    slug = lambda t: one(spark, t, naming.clip_slug(F.col("t")))[0]
    assert slug("Why 40 Loaves, Before Dawn?!") == "why-40-loaves-before-dawn"
    assert slug(" -- ") == "clip"
    name = lambda i, c, h, top=False: one(
        spark, h, naming.clip_filename(F.lit(i), F.lit(c), F.col("t"), F.lit(top)))[0]
    assert name(1, "story", "x", True) == "01_highest-potential.mp4"
    assert name(7, "statistic", "Three hundred loaves") == "07_stat_three-hundred-loaves.mp4"
    assert name(4, "Odd Sort!", "") == "04_odd-sort.mp4"
    assert name(123, "story", "Mill") == "123_story_mill.mp4" and name(1000, "story", "Mill") == "1000_story_mill.mp4"
    assert name(12, "story", "Mill") != name(123, "story", "Mill")
    safe = lambda t: one(spark, t, naming.sanitize_name(F.col("t")))[0]
    assert safe("a/b/../shadow copy") == "shadow-copy"
    assert safe("/srv/in/cat & dog|x.MOV") == "cat-dog-x.mov"
    assert not safe("..secret").startswith(".")
    assert safe("") == "video" and safe("Crème Brûlée.MP4") == "Creme-Brulee.mp4"
    assert safe("ﬁnal Ａ.mp4") == "final-A.mp4" and safe("Top™.mp4") == "TopTM.mp4" and safe("½ hour.mp4") == "12-hour.mp4"
    assert safe("𝐁old №5 ㎏ 漢.mkv") == "Bold-No5-kg.mkv"


def test_row_ids_do_not_collide(spark):
    rows = [(i,) for i in (1, 9, 10, 99, 100, 123, 1234)]
    got = [r[0] for r in spark.createDataFrame(rows, "i int").select(sinks.clip_rows_id(F.lit("p"), F.col("i"))).collect()]
    assert got == ["p-01", "p-09", "p-10", "p-99", "p-100", "p-123", "p-1234"]


def test_fallback_hook(spark):
    long = "So this is the tale of a mill that turned by hand through a whole winter without any power. And a second one."
    df = spark.createDataFrame([(long, "", "", "", False), ("Short one.", "Mine", "", "", True)],
                               "text string, hook string, alt_hook string, opening_text string, llm_used boolean")
    a, b = hooks.fallback_hook(df).collect()
    assert a.hook.endswith("…") and len(a.hook) <= 58 and a.hook.startswith("this is")
    assert a.alt_hook == "a second one" and len(a.opening_text) <= 38
    assert (b.hook, b.alt_hook, b.opening_text) == ("Mine", "", "Short one")
