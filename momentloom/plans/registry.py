"""Registered queries: each runs one operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.functions import lexicon as lx
from momentloom.functions import naming
from momentloom.functions import text as tx
from momentloom.operators import (
    boundaries, catalog, cues, evals, hooks, incremental, joins, keywords, scans, scores, seeds, segment,
    select, tracks, transcripts, windows,
)
from momentloom.plans import analyze as an
from momentloom.plans import oracle as o
from momentloom.plans.ordered import with_position
from momentloom.plans.stable import own, scope, settled, shared_dir, stable
from momentloom.sources import committed, lines, probe, sinks, transcripts as docs_in
from momentloom.streaming.blocks import stream_blocks_in_order, stream_pause_blocks
from momentloom.streaming.jobs import expiring_job_state, latest_job_state
from momentloom.streaming.run import closed_rows, latest_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Words that occur in the sample tables, so that every flag fires.
SAMPLE = lx.Lexicon(
    question=r"\b(from|pour)\b", number=r"\b(at|\d+)\b", contrast=r"\b(this|des)\b",
    emotion_words=("with", "und", "est"), strong_claim=r"\b(are|las)\b",
    story=r"\b(was|that is)\b", actionable=r"\b(for the|mit)\b",
)


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def doc_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Document lines on the reading clock, written once: every later step reads them
    at least twice (rows, and the summary that is carried between chunks)."""
    return settled(spark, lambda: lines.reading_clock(lines.lines_as_segments(documents(spark, sf), "doc_id")))


def doc_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return segment.build_timed_sentences(doc_segments(spark, sf))


def known_sentences(spark: SparkSession, sf: str, lex: lx.Lexicon = SAMPLE) -> DataFrame:
    """Sentences with their facts, written once."""
    return settled(spark, lambda: seeds.add_facts(doc_sentences(spark, sf), lex))


def turn_segments(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("transcript_id"), F.col("turn").alias("seg_idx"), tx.strip("text").alias("text"))
    return turns.where("text != ''")


# ------------------------------------------------------------------- text

@query("annotate_documents", f"SELECT doc_id, {o.annotation('text', lx.DEFAULT)} FROM documents")
def annotate_documents(spark, sf):
    return tx.annotate_text(documents(spark, sf)).drop("text")


@query("annotate_turns", f"""
    SELECT conv_id, turn, {o.annotation('text', SAMPLE)}, {o.strip_filler('text')} AS stripped FROM conversations""")
def annotate_turns(spark, sf):
    turns = table(spark, sf, "conversations").drop("role")
    return tx.annotate_text(turns, lex=SAMPLE).withColumn("stripped", tx.strip_leading_filler("text")).drop("text")


@query("explode_sentences", o.cte(
    ("parts", f"SELECT doc_id, {o.sentences('text')} AS a FROM documents"),
) + f" SELECT doc_id, {o.numbered('a', 'sentence', 'pos')} FROM parts")
def explode_sentences(spark, sf):
    return segment.explode_sentences(documents(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


@query("sentence_offsets")
def sentence_offsets(spark, sf):
    return segment.explode_sentences(documents(spark, sf), key=["doc_id"], offsets=True).withColumn("pos", F.col("pos").cast("bigint"))


ORACLES["sentence_offsets"] = o.cte(
    ("whole", f"SELECT doc_id, {o.strip('text')} AS t FROM documents"),
    ("parts", f"SELECT doc_id, {o.sentences('t')} AS a, t FROM whole"),
    ("rows", f"SELECT doc_id, t, {o.numbered('a', 'sentence', 'pos')} FROM parts"),
    # A sentence starts where the earlier ones end, after the blanks in between.
    ("packed", r"""SELECT *, sum(length(regexp_replace(sentence, '\s', '', 'g'))) OVER (PARTITION BY doc_id ORDER BY pos) AS solid FROM rows"""),
    ("chars", r"""SELECT doc_id, unnest(range(1, length(t) + 1)) AS place, unnest(string_split(t, '')) AS c FROM whole"""),
    ("solid_chars", r"""SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS nth FROM chars WHERE NOT regexp_matches(c, '^\s$')"""),
) + """ SELECT p.doc_id, p.pos, p.sentence, (s.place - length(p.sentence))::BIGINT AS start_char, s.place::BIGINT AS end_char
    FROM packed p JOIN solid_chars s ON s.doc_id = p.doc_id AND s.nth = p.solid"""
ORACLES["spread_sentences"] = ORACLES["sentence_offsets"]


@query("spread_sentences")
def spread_sentences(spark, sf):
    """Spans of 512 characters, so that most texts are cut."""
    return segment.spread_sentences(documents(spark, sf), key=["doc_id"], span=512).withColumn("pos", F.col("pos").cast("bigint"))


@query("top_keywords", o.cte(
    ("toks", f"SELECT doc_id, {o.numbered(o.tokens('text'), 'keyword', 'pos')} FROM documents"),
    ("counted", f"""SELECT doc_id, keyword, count(*) AS n, min(pos) AS first_pos FROM toks
        WHERE length(keyword) >= 4 AND keyword NOT IN ({', '.join(o.q(w) for w in lx.STOPWORDS)}) GROUP BY ALL"""),
    ("placed", """SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(keyword) DESC, first_pos))::INT AS rank FROM counted"""),
) + " SELECT doc_id, rank, keyword, n FROM placed WHERE rank <= 6")
def top_keywords(spark, sf):
    return keywords.top_keywords(documents(spark, sf), "doc_id")


# ------------------------------------------------------------ segmentation

SENTENCE_COLS = ["transcript_id", "seg_idx", "pos", "idx", "start_ms", "end_ms", "text", "gap_before_ms", "block"]


@query("timed_sentences", o.cte(*o.SENTS) + f" SELECT {', '.join(SENTENCE_COLS)} FROM sents")
def timed_sentences(spark, sf):
    out = doc_sentences(spark, sf).withColumn("pos", F.col("pos").cast("bigint"))
    return out.select(*SENTENCE_COLS)


def worded_segments(spark, sf) -> DataFrame:
    """Document lines with recogniser words on an even clock; every ninth word was heard wrong,
    and every fifth line has no words."""
    def word(token, i):
        at = F.col("start_ms") + i * 400
        return F.struct(
            at.alias("start_ms"), (at + 350).alias("end_ms"),
            F.when((F.col("seg_idx") + i) % 9 == 8, F.concat(F.lit("x"), token)).otherwise(token).alias("text"))

    heard = F.transform(F.filter(F.split("text", r"(?U)\s+"), lambda t: t != ""), word)
    none = F.slice(heard, 1, 0)
    return doc_segments(spark, sf).withColumn("words", F.when(F.col("seg_idx") % 5 == 4, none).otherwise(heard))


ALIGN_SQL = [*o.LINES, *o.CLOCK, *o.heard()]


@query("align_spans", o.cte(*ALIGN_SQL)
       + " SELECT transcript_id, seg_idx, pos, first_word, n_words FROM aligned")
def align_spans(spark, sf):
    """The run of words of each sentence of a line with several sentences and words."""
    segs = worded_segments(spark, sf).withColumn("parts", tx.sentences("text"))
    rows = segs.where("size(parts) > 1 AND size(words) > 0").select(
        "transcript_id", "seg_idx", "start_ms", "parts", segment.align_spans(F.col("words"), F.col("parts")).alias("runs"))
    # The outer form: the other adds a filter on the runs, which would align every line twice.
    rows = rows.select("transcript_id", "seg_idx", "start_ms", F.posexplode_outer("runs").alias("pos", "run"))
    return rows.where("pos is not null").select(
        "transcript_id", "seg_idx", F.col("pos").cast("bigint").alias("pos"),
        ((F.get("run", F.lit(0))["start_ms"] - F.col("start_ms")) / 400).cast("bigint").alias("first_word"),
        F.when(F.col("run").isNotNull(), F.size("run")).cast("bigint").alias("n_words"))


@query("word_timed_sentences", o.cte(*ALIGN_SQL, *o.WORD_TIMED) + f" SELECT {', '.join(SENTENCE_COLS)} FROM sents")
def word_timed_sentences(spark, sf):
    """Sentences of segments with words: by their run of words, else by length after the last run."""
    out = segment.build_timed_sentences(worded_segments(spark, sf))
    return out.withColumn("pos", F.col("pos").cast("bigint")).select(*SENTENCE_COLS)


@query("turn_sentences", o.cte(*o.TURNS, *o.CLOCK, *o.TIMED) + f" SELECT {', '.join(SENTENCE_COLS)} FROM sents")
def turn_sentences(spark, sf):
    out = segment.build_timed_sentences(lines.reading_clock(turn_segments(spark, sf)))
    return out.withColumn("pos", F.col("pos").cast("bigint")).select(*SENTENCE_COLS)


EVENT_SPANS = ("espan", """SELECT user_id, event_id, (epoch_us(ts) // 1000)::BIGINT AS start_ms,
    (epoch_us(ts) // 1000)::BIGINT + (round_even(value * 1000, 0)::BIGINT) AS end_ms FROM events""")
HOUR = 3_600_000


def event_spans(spark, sf) -> DataFrame:
    """Events as intervals [ts, ts + value seconds], per user."""
    start = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    return table(spark, sf, "events").select(
        "user_id", "event_id", start.alias("start_ms"),
        (start + F.rint(F.col("value") * 1000).cast("bigint")).alias("end_ms"))


@query("pause_blocks", o.cte(EVENT_SPANS,
    ("g", """SELECT *, row_number() OVER w - 1 AS pos, greatest(0, coalesce(start_ms - lag(end_ms) OVER w, 0))::BIGINT AS gap_before_ms
        FROM espan WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, event_id)"""),
) + f""" SELECT *, (sum((gap_before_ms >= {6 * HOUR})::INT) OVER (PARTITION BY user_id ORDER BY pos))::BIGINT AS block FROM g""")
def pause_blocks(spark, sf):
    placed = with_position(event_spans(spark, sf), ["user_id"], ["start_ms", "event_id"])
    return segment.assign_pause_blocks(placed, "user_id", "start_ms", "end_ms", "pos", 6 * HOUR)


@query("preview", o.cte(*o.TURNS,
    ("n", "SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seg_idx) AS r FROM lines"),
) + """ SELECT transcript_id, substr(string_agg(text, ' ' ORDER BY seg_idx), 1, 600) AS preview FROM n WHERE r <= 6 GROUP BY transcript_id""")
def preview(spark, sf):
    return transcripts.preview(turn_segments(spark, sf))


@query("topic_hint", o.cte(*o.LINES) + """ SELECT transcript_id, substr(string_agg(text, ' ' ORDER BY seg_idx), 1, 220) AS topic_hint
    FROM lines GROUP BY transcript_id""")
def topic_hint(spark, sf):
    return transcripts.topic_hint(lines.lines_as_segments(documents(spark, sf), "doc_id"))


@query("transcript_text", o.cte(*o.TURNS) + """ SELECT transcript_id, string_agg(text, ' ' ORDER BY seg_idx) AS text
    FROM lines GROUP BY transcript_id""")
def transcript_text(spark, sf):
    return transcripts.transcript_text(turn_segments(spark, sf))


# ------------------------------------------------------------------- seeds

SEED_COLS = ["transcript_id", "idx", "start_ms", "end_ms", "text", "strength", "reason"]


@query("find_seeds", o.cte(*o.SENTS, *o.seeds(lx.DEFAULT, None)) + f" SELECT {', '.join(SEED_COLS)} FROM strong")
def find_seeds(spark, sf):
    return seeds.find_seeds(doc_sentences(spark, sf)).select(*SEED_COLS)


@query("rank_seeds", o.cte(*o.SENTS, *o.seeds(SAMPLE, 40)) + f" SELECT {', '.join(SEED_COLS)}, seed_rank FROM seeds")
def rank_seeds(spark, sf):
    found = seeds.find_seeds(doc_sentences(spark, sf), SAMPLE)
    return seeds.rank_seeds(found).select(*SEED_COLS, "seed_rank")


@query("strongest_sentences", o.cte(*o.SENTS, *o.seeds(SAMPLE, 5)) + f" SELECT {', '.join(SEED_COLS)}, seed_rank FROM seeds")
def strongest_sentences(spark, sf):
    """The five strongest sentences of each document."""
    found = seeds.find_seeds(doc_sentences(spark, sf), SAMPLE)
    return seeds.rank_seeds(found, k=5).select(*SEED_COLS, "seed_rank")


# ----------------------------------------------------- windows and scores

WINDOW_COLS = ["transcript_id", "lo", "hi", "start_ms", "end_ms", "seed_rank", "target_ord"]
SCORE_COLS = ["score_" + n for n in (
    "engagement", "hook", "clarity", "self_contained", "emotion", "novelty", "story",
    "actionability", "audio_quality", "overall")]
WINDOWS_SQL = [*o.SENTS, *o.seeds(SAMPLE, 40), *o.windows()]


def cols(*names: str) -> str:
    return ", ".join(names)


def grown(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    text = known_sentences(spark, sf)
    top = stable(seeds.rank_seeds(seeds.find_seeds(text, SAMPLE)))
    return text, top, windows.expand_windows(text, top)


def candidates_of(text: DataFrame) -> DataFrame:
    """Scored, length-adjusted candidates of sentences with facts."""
    return settled(text.sparkSession, lambda: an.score_and_adjust(an.find_candidates(text, SAMPLE), SAMPLE))


def candidates(spark, sf) -> DataFrame:
    """Scored, length-adjusted candidates; their sentences do not stay on disk."""
    return settled(spark, lambda: an.score_and_adjust(an.find_candidates(known_sentences(spark, sf), SAMPLE), SAMPLE))


@query("expand_windows", o.cte(*WINDOWS_SQL) + f" SELECT {cols(*WINDOW_COLS)}, anchor, target_ms FROM windows")
def expand_windows(spark, sf):
    return grown(spark, sf)[2].select(*WINDOW_COLS, "anchor", "target_ms")


@query("forced_length_windows", o.cte(*o.SENTS, *o.seeds(SAMPLE, 40), *o.windows((30_000,)))
       + f" SELECT {cols(*WINDOW_COLS)} FROM windows")
def forced_length_windows(spark, sf):
    text = known_sentences(spark, sf)
    top = stable(seeds.rank_seeds(seeds.find_seeds(text, SAMPLE)))
    return windows.expand_windows(text, top, targets_ms=(30_000,)).select(*WINDOW_COLS)


@query("distinct_windows", o.cte(*WINDOWS_SQL) + f" SELECT {cols(*WINDOW_COLS)} FROM distinct_windows")
def distinct_windows(spark, sf):
    return windows.distinct_windows(grown(spark, sf)[2]).select(*WINDOW_COLS)


@query("fallback_windows", o.cte(*o.SENTS, *o.seeds(lx.DEFAULT, 40), *o.windows(), *o.fallback())
       + " SELECT transcript_id, lo, hi, start_ms, end_ms FROM even")
def fallback_windows(spark, sf):
    text = known_sentences(spark, sf, lx.DEFAULT)
    top = stable(seeds.rank_seeds(seeds.find_seeds(text)))
    found = windows.distinct_windows(windows.expand_windows(text, top))
    return windows.fallback_windows(text, stable(found)).select("transcript_id", "lo", "hi", "start_ms", "end_ms")


@query("fallback_windows_jumps", ORACLES["fallback_windows"])
def fallback_windows_jumps(spark, sf):
    """The same result by pointer jumps, as for keys of any size."""
    text = known_sentences(spark, sf, lx.DEFAULT)
    top = stable(seeds.rank_seeds(seeds.find_seeds(text)))
    found = stable(windows.distinct_windows(windows.expand_windows(text, top)))
    return windows.fallback_windows(text, found, fold_limit=10).select("transcript_id", "lo", "hi", "start_ms", "end_ms")


@query("candidate_windows", o.cte(*WINDOWS_SQL, *o.fallback(), *o.CANDIDATES)
       + f" SELECT {cols(*WINDOW_COLS, 'text', 'seed_reason', *lx.FLAGS)} FROM cands")
def candidate_windows(spark, sf):
    text = known_sentences(spark, sf)
    return an.find_candidates(text, SAMPLE).select(*WINDOW_COLS, "text", "seed_reason", *lx.FLAGS)


@query("score_candidates", o.cte(*WINDOWS_SQL, *o.fallback(), *o.CANDIDATES, *o.scores("cands", SAMPLE))
       + f" SELECT transcript_id, lo, hi, {cols(*SCORE_COLS)} FROM scored")
def score_candidates(spark, sf):
    text = known_sentences(spark, sf)
    found = an.find_candidates(text, SAMPLE)
    return scores.score_candidates(found, SAMPLE).select("transcript_id", "lo", "hi", *SCORE_COLS)


@query("score_turns", o.cte(
    ("src", "SELECT conv_id, turn, text, 0 AS start_ms, 32000 AS end_ms FROM conversations"), *o.scores("src", lx.DEFAULT),
) + f" SELECT conv_id, turn, {cols(*SCORE_COLS)} FROM scored")
def score_turns(spark, sf):
    turns = table(spark, sf, "conversations").withColumns({"start_ms": F.lit(0), "end_ms": F.lit(32_000)})
    return scores.score_candidates(turns).select("conv_id", "turn", *SCORE_COLS)


@query("blend_scores", o.cte(
    ("src", """SELECT d.doc_id, d.text, 0 AS start_ms, 40000 AS end_ms, l.quality * 100 AS eval_score
        FROM documents d LEFT JOIN labels l USING (doc_id)"""),
    *o.scores("src", SAMPLE),
    ("blended", f"""SELECT doc_id, start_ms, end_ms, score_hook, CASE WHEN eval_score IS NULL THEN score_overall ELSE
        {o.clamp('0.5::DOUBLE * score_overall + 0.5::DOUBLE * eval_score')} END AS score_overall,
        CASE WHEN eval_score IS NULL THEN score_engagement ELSE
        {o.clamp('0.5::DOUBLE * score_engagement + 0.5::DOUBLE * eval_score')} END AS score_engagement
        FROM scored"""), o.adjusted("blended"),
) + " SELECT doc_id, score_hook, score_overall, score_engagement FROM adjusted")
def blend_scores(spark, sf):
    docs = documents(spark, sf)
    docs = docs.join(table(spark, sf, "labels"), "doc_id", "left").withColumns({
        "eval_score": F.col("quality") * 100, "start_ms": F.lit(0), "end_ms": F.lit(40_000)})
    df = scores.length_adjust(scores.blend_scores(scores.score_candidates(docs, SAMPLE)))
    return df.select("doc_id", "score_hook", "score_overall", "score_engagement")


@query("length_adjust", o.cte(
    EVENT_SPANS,
    ("src", "SELECT event_id, start_ms, end_ms, (event_id % 101)::INT AS score_overall FROM espan"), o.adjusted("src"),
) + " SELECT event_id, score_overall FROM adjusted")
def length_adjust(spark, sf):
    spans = event_spans(spark, sf).withColumn("score_overall", (F.col("event_id") % 101).cast("int"))
    return scores.length_adjust(spans).select("event_id", "score_overall")


# --------------------------------------------------------------- selection

KEPT_COLS = ["transcript_id", "lo", "hi", "start_ms", "end_ms", "score_overall"]


@query("greedy_dedup", o.cte(*o.chain(SAMPLE), *o.dedup(o.LEVELS[:1])) + f" SELECT {cols(*KEPT_COLS)} FROM uniq")
def greedy_dedup(spark, sf):
    return select.greedy_dedup(candidates(spark, sf), order=an.ORDER).select(*KEPT_COLS)


@query("greedy_dedup_rounds", ORACLES["greedy_dedup"])
def greedy_dedup_rounds(spark, sf):
    """The same result by rounds over components, as for keys of any size."""
    return select.greedy_dedup_any(candidates(spark, sf), order=an.ORDER, unit_rows=20).select(*KEPT_COLS)


@query("greedy_dedup_units", ORACLES["greedy_dedup"])
def greedy_dedup_units(spark, sf):
    """The same result in one pass per key, as for keys of some ten thousand candidates."""
    return select.greedy_dedup_any(candidates(spark, sf), order=an.ORDER).select(*KEPT_COLS)


@query("relaxed_dedup", o.cte(*o.chain(SAMPLE), *o.dedup(o.LEVELS, n=5)) + f" SELECT {cols(*KEPT_COLS)} FROM uniq")
def relaxed_dedup(spark, sf):
    return select.relaxed_dedup_any(candidates(spark, sf), 5, order=an.ORDER).select(*KEPT_COLS)


@query("relaxed_dedup_rounds", ORACLES["relaxed_dedup"])
def relaxed_dedup_rounds(spark, sf):
    """The same result by rounds, as for keys of any size."""
    return select.relaxed_dedup_any(candidates(spark, sf), 5, order=an.ORDER, fold_limit=10).select(*KEPT_COLS)


CHOSEN_SQL = [*o.chain(SAMPLE), *o.dedup(o.LEVELS, n=5), o.top_n(5)]


def distinct_candidates(scored: DataFrame) -> DataFrame:
    """The distinct ones among candidates, without their texts."""
    return settled(scored.sparkSession, lambda: select.relaxed_dedup_any(scored, 5, order=an.ORDER).drop("text"))


def chosen(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Sentences, and the ranked best five; nothing else of the chain stays on disk."""
    with scope(spark) as keep:
        text = keep(known_sentences(spark, sf))
        best = select.select_top_n(distinct_candidates(candidates_of(text)), 5, order=("start_ms", *an.ORDER))
        best = best.withColumn("clip_id", F.concat_ws("-", "transcript_id", "lo", "hi"))
        return text, keep(select.rank_clips(best, order=("start_ms", *an.ORDER)))


@query("select_and_rank", o.cte(*CHOSEN_SQL) + f" SELECT {cols(*KEPT_COLS, 'clip_id', 'index')} FROM best")
def select_and_rank(spark, sf):
    return chosen(spark, sf)[1].select(*KEPT_COLS, "clip_id", "index")


@query("analysis_stats", o.cte(*o.chain(SAMPLE), *o.dedup(o.LEVELS, n=5)) + """
    SELECT a.transcript_id, a.n AS n_candidates, coalesce(b.n, 0)::BIGINT AS n_unique, false AS llm_used
    FROM (SELECT transcript_id, count(*) AS n FROM adjusted GROUP BY ALL) a
    LEFT JOIN (SELECT transcript_id, count(*) AS n FROM uniq GROUP BY ALL) b USING (transcript_id)""")
def analysis_stats(spark, sf):
    scored = candidates(spark, sf)
    return select.analysis_stats(scored, distinct_candidates(scored))


@query("interval_overlap_pairs", o.cte(EVENT_SPANS) + """ SELECT a.user_id, a.event_id AS id_a, b.event_id AS id_b,
    greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) /
        greatest(0.001::DOUBLE, least(a.end_ms - a.start_ms, b.end_ms - b.start_ms)) AS overlap
    FROM espan a JOIN espan b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.start_ms < b.end_ms AND b.start_ms < a.end_ms""")
def interval_overlap_pairs(spark, sf):
    return joins.interval_overlap_pairs(event_spans(spark, sf), "user_id", "event_id", "start_ms", "end_ms", 300_000)


@query("interval_overlap_mixed", """WITH m AS (SELECT user_id, event_id, (epoch_us(ts) // 1000)::BIGINT AS s, (epoch_us(ts) // 1000 + CASE WHEN event_id % 50 = 0 THEN 2592000000 ELSE 600000 END)::BIGINT AS e FROM events),
p AS (SELECT a.user_id, a.event_id AS id_a, b.event_id AS id_b, greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / greatest(0.001::DOUBLE, least(a.e - a.s, b.e - b.s)) AS overlap
    FROM m a JOIN m b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, me ORDER BY overlap DESC, other) AS n FROM (
    SELECT *, id_a AS me, id_b AS other FROM p WHERE overlap >= 0.5 UNION ALL SELECT *, id_b, id_a FROM p WHERE overlap >= 0.5))
SELECT DISTINCT user_id, id_a, id_b, overlap FROM r WHERE n <= 5""")
def interval_overlap_mixed(spark, sf):
    """A few spans of a month among spans of ten minutes; the five strongest partners of each."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    length = F.when(F.col("event_id") % 50 == 0, F.lit(30 * DAY)).otherwise(F.lit(600_000))
    spans = table(spark, sf, "events").select("user_id", "event_id", ms.alias("s"), (ms + length).alias("e"))
    return joins.interval_overlap_pairs(spans, "user_id", "event_id", "s", "e", 600_000, min_ratio=0.5, top=5)


@query("text_jaccard", f"""SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE
    len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS similarity
    FROM (SELECT conv_id, turn, list_distinct({o.tokens('text')}) AS a,
        list_distinct({o.tokens("coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '')")}) AS b FROM conversations)""")
def text_jaccard(spark, sf):
    """Similarity of each turn to the turn before it."""
    turns = table(spark, sf, "conversations")
    prior = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))
    both = turns.join(prior, ["conv_id", "turn"], "left")
    return both.select("conv_id", "turn", tx.text_jaccard(F.col("text"), F.coalesce("before", F.lit(""))).alias("similarity"))


# -------------------------------------------------------------- boundaries

REFINED_SQL = [*CHOSEN_SQL, *o.EVEN_WORDS, *o.GAPS, *o.refined()]


def refined_clips(spark, sf) -> DataFrame:
    def build() -> DataFrame:
        text, best = chosen(spark, sf)
        durations = text.groupBy("transcript_id").agg(F.max("end_ms").alias("duration_ms"))
        # Words are some times as large as their texts, so they are made where they are read.
        return boundaries.refine_boundaries(best, lines.even_words(text), durations)

    return settled(spark, build)


@query("covering_sentences", o.cte(*CHOSEN_SQL, *o.refined()[:3]) + " SELECT clip_id, idx, s_start, s_end FROM covered")
def covering_sentences(spark, sf):
    text, best = chosen(spark, sf)
    return boundaries.covering_sentences(best, text).select("clip_id", "idx", "s_start", "s_end")


@query("trim_edges", o.cte(*CHOSEN_SQL, *o.refined()[:5]) + " SELECT clip_id, idx FROM within")
def trim_edges(spark, sf):
    text, best = chosen(spark, sf)
    facts = text.withColumns({"awk": F.col("facts.starts_awkwardly"), "inc": F.col("facts.looks_incomplete")})
    covered = boundaries.covering_sentences(best, facts, carry=["awk", "inc"])
    return boundaries.trim_edges(covered).select("clip_id", "idx")


@query("word_gaps", o.cte(*o.SENTS, *o.EVEN_WORDS, *o.GAPS) + " SELECT transcript_id, mid AS mid_ms FROM gaps")
def word_gaps(spark, sf):
    return boundaries.word_gaps(lines.even_words(doc_sentences(spark, sf)))


@query("nearest_gap", o.cte(
    *o.SENTS, *o.EVEN_WORDS, *o.GAPS,
    ("x", "SELECT transcript_id, seg_idx, (start_ms + end_ms) // 2 AS t FROM segs"),
    ("near", """SELECT x.transcript_id, x.seg_idx, x.t, round_even(arg_min(g.mid, (abs(g.mid - x.t), g.mid)), 0) AS g FROM x
        LEFT JOIN gaps g ON g.transcript_id = x.transcript_id AND abs(g.mid - x.t) <= 2500 GROUP BY ALL"""),
) + " SELECT transcript_id, seg_idx, t, CASE WHEN abs(g - t) < 1200 THEN g::BIGINT ELSE t END AS cut FROM near")
def nearest_gap(spark, sf):
    segs = doc_segments(spark, sf)
    middle = F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("bigint")
    gaps = boundaries.word_gaps(lines.even_words(segment.build_timed_sentences(segs)))
    return boundaries.nearest_gap(segs.select("transcript_id", "seg_idx", middle.alias("t")), gaps, "transcript_id", "t", "cut")


@query("refine_boundaries", o.cte(*REFINED_SQL)
       + " SELECT f.clip_id, f.start_ms, f.end_ms, t.text FROM final_spans f JOIN clip_texts t USING (clip_id)")
def refine_boundaries(spark, sf):
    return refined_clips(spark, sf).select("clip_id", "start_ms", "end_ms", "text")


@query("clip_segments", o.cte(*REFINED_SQL, ("kept_words", """SELECT r.clip_id, r.n, count(w.idx) AS n_words FROM clip_rows r
    LEFT JOIN words w ON w.transcript_id = r.transcript_id AND w.idx = r.idx AND w.w_end > r.start_ms AND w.w_start < r.end_ms GROUP BY ALL"""))
    + """ SELECT r.clip_id, r.n, r.seg_start AS start_ms, r.seg_end AS end_ms, r.text, k.n_words
    FROM clip_rows r JOIN kept_words k USING (clip_id, n)""")
def clip_segments(spark, sf):
    rows = refined_clips(spark, sf).select("clip_id", F.posexplode("segments").alias("n", "s"))
    return rows.select(
        "clip_id", F.col("n").cast("bigint").alias("n"), "s.start_ms", "s.end_ms", "s.text",
        F.size("s.words").cast("bigint").alias("n_words"))


# --------------------------------------------------------- cues and tracks

CUES_SQL = [*REFINED_SQL, *o.CLIP_WORDS, *o.cues(3)]
EMPHASIS = ("the", "with", "und", "est")


def clip_cues(spark, sf) -> DataFrame:
    clips = refined_clips(spark, sf)
    spoken = clips.select("clip_id", "start_ms", F.flatten(F.transform("segments", lambda s: s["words"])).alias("words"))
    return cues.cues_from_words(spoken, 3)


@query("cues_from_words", o.cte(*CUES_SQL) + " SELECT clip_id, cue_idx, start_ms, end_ms, words, n FROM cues")
def cues_from_words(spark, sf):
    joined = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    return clip_cues(spark, sf).select(
        "clip_id", "cue_idx", "start_ms", "end_ms", joined.alias("words"), F.size("words").cast("bigint").alias("n"))


@query("active_word_events", o.cte(*CUES_SQL, *o.events(EMPHASIS))
       + " SELECT clip_id, cue_idx, word_idx, start_ms, end_ms, text, is_emphasis FROM word_events")
def active_word_events(spark, sf):
    marked = F.array(*[F.lit(w) for w in EMPHASIS])
    return cues.active_word_events(clip_cues(spark, sf), marked).withColumn("word_idx", F.col("word_idx").cast("bigint"))


@query("cues_from_segments", o.cte(
    *o.LINES, *o.CLOCK,
    ("toks", "SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS t FROM segs"),
    ("timed", "SELECT *, greatest(0, start_ms)::DOUBLE AS s, greatest(start_ms + 300.0::DOUBLE, end_ms::DOUBLE) AS e, (len(t) + 3) // 4 AS n FROM toks"),
    ("chunked", "SELECT *, unnest(range(0, n)) AS part, (e - s) / n AS dur FROM timed"),
    ("begun", "SELECT *, s + part * dur AS cs FROM chunked"),
) + """ SELECT transcript_id, seg_idx, part::INT AS part, round_even(cs, 0)::BIGINT AS start_ms, round_even(cs + dur, 0)::BIGINT AS end_ms,
    array_to_string(t[part * 4 + 1 : part * 4 + 4], ' ') AS words,
    round_even(cs + ((cs + dur) - cs) / len(t[part * 4 + 1 : part * 4 + 4]), 0)::BIGINT AS first_word_end FROM begun""")
def cues_from_segments(spark, sf):
    segs = doc_segments(spark, sf).withColumn("clip_start_ms", F.lit(0))
    out = cues.cues_from_segments(segs, 4, "transcript_id")
    joined = F.array_join(F.transform("words", lambda w: w["text"]), " ")
    return out.withColumn("first_word_end", F.col("words")[0]["end_ms"]).withColumn("words", joined)


DAY = 24 * HOUR
TILE, GRID = 3 * DAY, HOUR
TRACK_SQL = o.tracks(GRID, TILE)


def observations(spark, sf) -> DataFrame:
    """Events as a position track per user: width grows with the event id."""
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("track_id"), ms.alias("t_ms"), (F.col("value") / 500.0).alias("cx"), "event_id")


def tiles(obs: DataFrame) -> DataFrame:
    tile = F.floor(F.col("t_ms") / TILE).cast("bigint")
    return obs.select("track_id", tile.alias("tile")).distinct().select(
        "track_id", F.concat_ws("-", "track_id", "tile").alias("clip_id"),
        (F.col("tile") * TILE).alias("start_ms"), ((F.col("tile") + 1) * TILE).alias("end_ms"))


def resampled(spark, sf) -> DataFrame:
    obs = observations(spark, sf)
    return tracks.resample_linear(obs, tiles(obs), "cx", GRID, bucket_ms=DAY)


def resampled_chunks(spark, sf) -> DataFrame:
    obs = observations(spark, sf)
    return tracks.resample_chunks(obs, tiles(obs), "cx", GRID, bucket_ms=DAY)


@query("largest_per_frame", """SELECT user_id AS track_id, (epoch_us(ts) // 86400000000)::BIGINT AS t_ms, arg_max(event_id, (value, -event_id)) AS event_id,
    max(value) AS w FROM events GROUP BY ALL""")
def largest_per_frame(spark, sf):
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000).cast("bigint")
    obs = table(spark, sf, "events").select(
        F.col("user_id").alias("track_id"), day.alias("t_ms"), "event_id", F.col("event_id").alias("cx"), F.lit(0).alias("cy"),
        F.col("value").alias("w"), F.lit(1.0).alias("h"))
    return tracks.largest_per_frame(obs).select("track_id", "t_ms", "event_id", "w")


@query("resample_linear", o.cte(*TRACK_SQL) + " SELECT clip_id, i, t_ms, value FROM resampled")
def resample_linear(spark, sf):
    return resampled(spark, sf)


@query("ema_two_pass", o.cte(*TRACK_SQL, *o.SMOOTH) + " SELECT clip_id, i, y AS value FROM bwd")
def ema_two_pass(spark, sf):
    chunks = resampled_chunks(spark, sf)
    return scans.unchunked(tracks.smoothed(chunks), "i", "value")


@query("slew_limit", o.cte(*TRACK_SQL, ("src", "SELECT clip_id, i, value AS y FROM resampled"), *o.slewed("src", "0.01::DOUBLE"))
       + " SELECT clip_id, i, y AS value FROM slew")
def slew_limit(spark, sf):
    chunks = resampled_chunks(spark, sf).withColumn("step", F.lit(0.01))
    return scans.unchunked(tracks.slew_limited(chunks, "step").drop("step"), "i", "value")


def long_track(spark, sf) -> DataFrame:
    """All order lines as one track, far longer than a chunk."""
    rows = table(spark, sf, "lineitem").select(
        F.lit("all").alias("track"), "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("value"))
    line = with_position(rows, ["track"], ["l_orderkey", "l_linenumber", "value"], "i")
    return scans.chunked(line, "track", "i", "value")


@query("smooth_long_track", """WITH s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_extendedprice) - 1 AS i, l_extendedprice::DOUBLE AS x FROM lineitem),
m AS (SELECT max(i) AS last FROM s),
f AS (SELECT s.i + k AS j, sum(x * pow(0.84::DOUBLE, k) * CASE WHEN s.i = 0 THEN 1.0::DOUBLE ELSE 0.16::DOUBLE END) AS y FROM s, m, range(0, 250) r(k) WHERE s.i + k <= last GROUP BY s.i + k),
g AS (SELECT f.j - k AS i, sum(y * pow(0.4::DOUBLE, k) * CASE WHEN f.j = last THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) AS y FROM f, m, range(0, 60) r(k) WHERE f.j >= k GROUP BY f.j - k)
SELECT i, round(y, 2) AS value FROM g""")
def smooth_long_track(spark, sf):
    return scans.unchunked(tracks.smoothed(long_track(spark, sf), "track"), "i", "value").select("i", F.round("value", 2).alias("value"))


@query("slew_long_track")
def slew_long_track(spark, sf):
    """Checked against a plain loop in the tests; SQL would need one step per row."""
    chunks = long_track(spark, sf).withColumn("step", F.lit(500.0))
    return scans.unchunked(tracks.slew_limited(chunks, "step", "track").drop("step"), "i", "value").select("i", "value")


@query("lock_if_static", o.cte(*TRACK_SQL) + """ SELECT clip_id, CASE WHEN (max(value) - min(value)) / 1.0::DOUBLE < 0.06
    THEN round(list_reduce(list(value ORDER BY i), lambda a, x: a + x) / count(*), 9) END AS locked FROM resampled GROUP BY clip_id""")
def lock_if_static(spark, sf):
    grid = tracks.collect_grid(resampled_chunks(spark, sf))
    return grid.select("clip_id", F.round(tracks.lock_if_static(F.col("xs"), F.lit(1.0)), 9).alias("locked"))


@query("decimate_changes", o.cte(*TRACK_SQL,
    ("px", "SELECT clip_id, i, round_even(value * 50, 0)::BIGINT AS x FROM resampled"),
    ("was", "SELECT *, lag(x) OVER (PARTITION BY clip_id ORDER BY i) AS p, max(i) OVER (PARTITION BY clip_id) AS m FROM px"),
) + f" SELECT clip_id, i * {GRID} AS t_ms, x FROM was WHERE i = 0 OR i = m OR x <> p")
def decimate_changes(spark, sf):
    grid = tracks.collect_grid(resampled_chunks(spark, sf))
    scaled = F.transform("xs", lambda v: v * 50)
    return grid.select("clip_id", F.explode_outer(tracks.decimate_changes(scaled, GRID, F.lit(TILE))).alias("k")).select("clip_id", "k.*")


VIDEO_SQL = ("videos", "SELECT p_partkey, 640 + p_size * 20 AS width, (CASE WHEN p_partkey % 3 = 0 THEN 1920 ELSE 720 END)::INT AS height FROM part")


def videos(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", (F.lit(640) + F.col("p_size") * 20).alias("width"),
        F.when(F.col("p_partkey") % 3 == 0, 1920).otherwise(720).alias("height"))


@query("crop_geometry", o.cte(VIDEO_SQL,
    ("c", "SELECT *, width / height <= 0.5625::DOUBLE + 0.001::DOUBLE AS portrait FROM videos"),
    ("w", "SELECT *, CASE WHEN portrait THEN width ELSE least(width, round_even(height * 0.5625::DOUBLE, 0)::INT) END AS crop_w FROM c"),
) + """ SELECT p_partkey, crop_w, CASE WHEN portrait THEN least(height, round_even(width / 0.5625::DOUBLE, 0)::INT) ELSE height END AS crop_h,
    (CASE WHEN portrait THEN greatest(0, (height - least(height, round_even(width / 0.5625::DOUBLE, 0)::INT)) // 2) ELSE 0 END)::INT AS y_top,
    (CASE WHEN portrait THEN 0 ELSE round_even((width - crop_w) / 2.0::DOUBLE, 0) END)::INT AS x FROM w""")
def crop_geometry(spark, sf):
    return tracks.crop_geometry(videos(spark, sf), "center").select("p_partkey", "crop_w", "crop_h", "y_top", "x")


@query("crop_geometry_fit", f"WITH {VIDEO_SQL[0]} AS ({VIDEO_SQL[1]}) SELECT p_partkey, width AS crop_w, height AS crop_h, 0 AS y_top, 0 AS x FROM videos")
def crop_geometry_fit(spark, sf):
    return tracks.crop_geometry(videos(spark, sf), "fit").select("p_partkey", "crop_w", "crop_h", "y_top", "x")


PAN = "greatest(2.0::DOUBLE, 0.18::DOUBLE * 1312 * 3600.0::DOUBLE)"


@query("plan_crop", o.cte(*TRACK_SQL,
    ("cx", "SELECT clip_id, i, value * 1920.0::DOUBLE AS v FROM resampled"),
    ("spread", "SELECT clip_id, (max(v) - min(v)) / 1920.0::DOUBLE < 0.06 AS still, list_reduce(list(v ORDER BY i), lambda a, x: a + x) / count(*) AS mean FROM cx GROUP BY ALL"),
    ("raw", "SELECT clip_id, i, greatest(0.0::DOUBLE, least(1312.0::DOUBLE, v - 304.0::DOUBLE)) AS value FROM cx JOIN spread USING (clip_id) WHERE NOT still"),
    *[(n, b.replace("resampled", "raw")) for n, b in o.SMOOTH],
    *o.slewed("bwd", PAN),
    ("px", "SELECT clip_id, i, round_even(greatest(0.0::DOUBLE, least(1312.0::DOUBLE, y)), 0)::BIGINT AS x FROM slew"),
    ("was", "SELECT *, lag(x) OVER (PARTITION BY clip_id ORDER BY i) AS p, max(i) OVER (PARTITION BY clip_id) AS m FROM px"),
) + f""" SELECT clip_id, 608 AS crop_w, false AS static, i * {GRID} AS t_ms, x FROM was WHERE i = 0 OR i = m OR x <> p
    UNION ALL SELECT clip_id, 608, true, 0, round_even(greatest(0.0::DOUBLE, least(1312.0::DOUBLE, mean - 304.0::DOUBLE)), 0)::BIGINT FROM spread WHERE still""")
def plan_crop(spark, sf):
    obs = observations(spark, sf)
    size = obs.select("track_id").distinct().withColumns({"width": F.lit(1920), "height": F.lit(1080)})
    plans = tracks.plan_crop(size, tiles(obs), obs, step_ms=GRID, bucket_ms=DAY)
    return plans.select("clip_id", "crop_w", "static", F.explode("keys").alias("k")).select("clip_id", "crop_w", "static", "k.*")


# ------------------------------------------------------------------ naming

@query("page_names", f"""SELECT page_id, {o.slug('url')} AS slug, {o.slug("regexp_extract(html, '<title>([^<]*)', 1)", 32)} AS title_slug,
    regexp_replace(url, '^.*/', '') AS base FROM pages""")
def page_names(spark, sf):
    pages = table(spark, sf, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return pages.select(
        "page_id", naming.clip_slug(F.col("url")).alias("slug"), naming.clip_slug(title, 32).alias("title_slug"),
        F.regexp_replace("url", "^.*/", "").alias("base"))


SAFE = "regexp_replace(trim(regexp_replace(stem, '[^A-Za-z0-9._-]+', '-', 'g'), '-._'), '-{2,}', '-', 'g')"


# Base names with characters outside ASCII, and what becomes of them, written down by hand.
MARKED = (("ﬁnal Ａ ", "final A "), ("Top™ ", "TopTM "), ("½ hour ", "12 hour "), ("Œuf № 5 ", "uf No 5 "), ("crème ", "creme "))


@query("sanitize_names", o.cte(
    ("base", f"""SELECT page_id, (CASE page_id % 6 {" ".join(f"WHEN {k} THEN {o.q(plain)}" for k, (_, plain) in enumerate(MARKED))} ELSE '' END)
        || regexp_replace(strip_accents(replace(replace(regexp_replace(url, '^.*/', ''), 'ß', ''), 'ẞ', '')), '[^\\x00-\\x7F]', '', 'g') AS b FROM pages"""),
    ("cut", r"""SELECT page_id, CASE WHEN regexp_matches(b, '^\.*[^.].*\.[^.]*$') THEN regexp_extract(b, '^(\.*[^.].*)(\.[^.]*)$', 1) ELSE b END AS stem,
        CASE WHEN regexp_matches(b, '^\.*[^.].*\.[^.]*$') THEN regexp_replace(lower(regexp_extract(b, '^(\.*[^.].*)(\.[^.]*)$', 2)), '[^a-z0-9._-]+', '', 'g') ELSE '' END AS ext FROM base"""),
) + f" SELECT page_id, substr(coalesce(nullif({SAFE}, ''), 'video'), 1, 80) || ext AS name FROM cut")
def sanitize_names(spark, sf):
    marks = F.array(*[F.lit(m) for m, _ in MARKED], F.lit(""))
    mark = F.get(marks, (F.col("page_id") % 6).cast("int"))
    name = F.concat(mark, F.regexp_replace("url", "^.*/", ""))
    return table(spark, sf, "pages").select("page_id", naming.sanitize_name(name).alias("name"))


@query("clip_ids", "SELECT doc_id, source || '-' || printf('%02d', doc_id * 7 % 1500) AS clip_id FROM documents")
def clip_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", sinks.clip_rows_id(F.col("source"), F.col("doc_id") * 7 % 1500).alias("clip_id"))


FIRST, SECOND = o.hook_parts("text")


@query("fallback_hooks", o.cte(
    ("h", f"SELECT doc_id, source, {FIRST} AS f, {SECOND} AS s FROM documents"),
    ("k", f"SELECT doc_id, source, {o.shorten('f', 60)} AS hook, coalesce({o.shorten('s', 60)}, '') AS alt_hook FROM h"),
    ("n", f"SELECT *, {o.shorten('hook', 40)} AS opening_text, (doc_id % 1200 + 1)::INT AS index FROM k"),
) + f""" SELECT doc_id, hook, alt_hook, opening_text, {o.slug("coalesce(nullif(hook, ''), source)")} AS slug,
    {o.file_name('index', 'source', 'hook', 'index = 1')} AS file_name FROM n""")
def fallback_hooks(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", F.col("source").alias("category"), (F.col("doc_id") % 1200 + 1).cast("int").alias("index"))
    named = hooks.name_clips(hooks.fallback_hook(docs))
    return named.select("doc_id", "hook", "alt_hook", "opening_text", "slug", "file_name")


# --------------------------------------------------------------- evaluator

EVAL_CANDS = ("ec", f"""SELECT conv_id AS transcript_id, turn AS position, {o.strip('text')} AS text, 0 AS start_ms,
    (greatest(1, {o.words('text')}) * 400) AS end_ms FROM conversations""")


def eval_candidates(spark, sf) -> DataFrame:
    """Chat turns as candidates; ``turn`` is their dense position."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("transcript_id"), F.col("turn").alias("position"), tx.strip("text").alias("text"),
        F.lit(0).alias("start_ms"), (F.greatest(F.lit(1), tx.word_count("text")) * 400).alias("end_ms"))


@query("eval_batches", o.cte(EVAL_CANDS) + """ SELECT transcript_id, position // 6 AS batch, count(*)::INT AS n_expected,
    string_agg('[' || (position % 6) || '] (' || round_even((end_ms - start_ms) / 1000.0::DOUBLE, 0)::BIGINT || 's) ' || text, chr(10) || chr(10) ORDER BY position) AS listing
    FROM ec GROUP BY ALL""")
def eval_batches(spark, sf):
    return evals.build_eval_batches(eval_candidates(spark, sf), "position")


def score_prompt(listing: str) -> str:
    """A stand-in scorer: the length of each entry, as JSON in a fenced block; it fails
    on listings without any blank."""
    entries = listing.split("\n\n[")
    if " " not in listing:
        raise ValueError("nothing to score")
    rows = ", ".join(f'{{"index": {i}, "score": {len(e) % 101}, "category": "Story"}}' for i, e in enumerate(entries))
    return "Here it is:\n```json\n{\"results\": [" + rows + ",]}\n```"


@query("evaluate_batches", o.cte(EVAL_CANDS,
    ("listed", """SELECT transcript_id, position // 6 AS batch, position % 6 AS slot, '[' || (position % 6) || '] (' ||
        round_even((end_ms - start_ms) / 1000.0::DOUBLE, 0)::BIGINT || 's) ' || text AS entry FROM ec"""),
) + """ SELECT transcript_id, batch, slot::INT AS slot, ((length(entry) - CASE WHEN slot = 0 THEN 0 ELSE 1 END) % 101)::INT AS score, 'story' AS category FROM listed""")
def evaluate_batches(spark, sf):
    """Batches through a scorer, its text parsed and matched back to slots."""
    answered = evals.evaluate_with(evals.build_eval_batches(eval_candidates(spark, sf), "position"), score_prompt)
    matched = evals.match_evals(evals.parse_eval_responses(answered))
    return matched.select("transcript_id", "batch", F.col("slot").cast("int").alias("slot"), "score", "category")


def responses(spark, sf) -> DataFrame:
    """Answers derived from labels, broken in ways that the reader must repair."""
    body = F.format_string('{"score": %d, "hook": "Doc %d", "selfContained": "%s", "emphasis_words": ["w%d", "", 7]}',
                           F.col("quality") * 150, F.col("doc_id"), F.when(F.col("toxic") == 0, "true").otherwise("false"), F.col("doc_id"))
    kind = F.col("doc_id") % 6
    raw = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(kind == 2, F.regexp_replace(body, "}$", ",}"))
        .when(kind == 3, F.translate(body, '"', "'"))
        .when(kind == 4, F.concat(F.lit("text {} and "), body, F.lit(" trailing")))
        .otherwise(F.lit("no json here"))
    )
    return table(spark, sf, "labels").select("doc_id", raw.alias("raw"))


@query("parse_eval_responses", """SELECT doc_id, doc_id % 6 < 5 AS is_valid, CASE WHEN doc_id % 6 < 5 THEN least(100, quality * 150)::INT ELSE -1 END AS score,
    CASE WHEN doc_id % 6 < 5 THEN 'Doc ' || doc_id END AS hook, doc_id % 6 < 5 AND toxic = 0 AS self_contained,
    CASE WHEN doc_id % 6 < 5 THEN 'insight' END AS category, CASE WHEN doc_id % 6 < 5 THEN 'w' || doc_id END AS emphasis FROM labels""")
def parse_eval_responses(spark, sf):
    parsed = evals.parse_eval_responses(responses(spark, sf))
    valid = evals.validate_evals(parsed.where("parsed is not null").select("doc_id", "parsed"))
    typed = valid.select("doc_id", F.lit(True).alias("is_valid"), "score", "hook", "self_contained", "category",
                         F.array_join("emphasis_words", "|").alias("emphasis"))
    rejects = parsed.where("parsed is null").select(
        "doc_id", F.lit(False).alias("is_valid"), F.lit(-1).alias("score"), F.lit(False).alias("self_contained"))
    return typed.unionByName(rejects, allowMissingColumns=True)


@query("merge_evals", o.cte(
    ("src", """SELECT d.doc_id, d.source, l.quality, l.toxic, l.doc_id IS NOT NULL AND d.doc_id % 6 < 5 AS hit FROM documents d LEFT JOIN labels l USING (doc_id)"""),
) + """ SELECT doc_id, CASE WHEN hit THEN 'Doc ' || doc_id ELSE 'old ' || source END AS hook, CASE WHEN hit THEN toxic = 0 ELSE true END AS self_contained,
    CASE WHEN hit THEN least(100, quality * 150)::INT ELSE -1 END AS eval_score, hit AS llm_used, CASE WHEN hit THEN 'w' || doc_id ELSE 'none' END AS emphasis FROM src""")
def merge_evals(spark, sf):
    parsed = evals.parse_eval_responses(responses(spark, sf)).where("parsed is not null")
    valid = evals.validate_evals(parsed.select("doc_id", "parsed"))
    cands = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("old "), F.col("source")).alias("hook"), F.array(F.lit("none")).alias("emphasis_words"))
    out = evals.merge_evals(cands, valid, ["doc_id"])
    return out.select("doc_id", "hook", "self_contained", F.coalesce("eval_score", F.lit(-1)).alias("eval_score"), "llm_used", F.array_join("emphasis_words", "|").alias("emphasis"))


# ------------------------------------------------------ keyed table changes

def order_parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Orders as a table, and changed or new rows for some of its keys."""
    base = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    delta = base.where("o_orderstatus = 'F'").select(
        (F.col("o_orderkey") * 2).alias("o_orderkey"), "o_custkey", F.lit("X").alias("o_orderstatus"),
        F.when(F.col("o_totalprice") > 200_000, F.col("o_totalprice")).alias("o_totalprice"))
    return base, delta


DELTA = [
    ("base", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    ("delta", """SELECT o_orderkey * 2 AS o_orderkey, o_custkey, 'X' AS o_orderstatus, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS o_totalprice
        FROM base WHERE o_orderstatus = 'F'"""),
]


@query("replace_by_key", o.cte(*DELTA) + """ SELECT * FROM base WHERE o_custkey NOT IN (SELECT o_custkey FROM delta) UNION ALL SELECT * FROM delta""")
def replace_by_key(spark, sf):
    base, delta = order_parts(spark, sf)
    return incremental.replace_by_key(base, delta, ["o_custkey"])


@query("replace_keys_in_table", ORACLES["replace_by_key"])
def replace_keys_in_table(spark, sf):
    """The same through a bucketed table on disk of which only touched buckets change."""
    base, delta = order_parts(spark, sf)
    path = own(spark, f"{shared_dir(spark)}/momentloom/orders-{uuid.uuid4().hex}") + "/orders"
    sinks.write_keyed(base, path, "o_custkey", 8)
    sinks.replace_keys(spark, delta, path)
    return spark.read.parquet(path).drop(sinks.BUCKET)


@query("committed_table", ORACLES["replace_by_key"])
def committed_table(spark, sf):
    """The same through a table whose changes appear with one rename; a second change puts nothing new."""
    base, delta = order_parts(spark, sf)
    path = own(spark, f"{shared_dir(spark)}/momentloom/orders-{uuid.uuid4().hex}") + "/orders"
    committed.create(base, path, "o_custkey", 8)
    committed.change(spark, delta, path)
    committed.change(spark, delta, path)
    return committed.read(spark, path)


@query("upsert_by_key", o.cte(*DELTA) + """ SELECT * FROM base WHERE o_orderkey NOT IN (SELECT o_orderkey FROM delta) UNION ALL SELECT * FROM delta""")
def upsert_by_key(spark, sf):
    base, delta = order_parts(spark, sf)
    return incremental.upsert_by_key(base, delta, ["o_orderkey"])


@query("patch_by_key", o.cte(*DELTA) + """ SELECT b.o_orderkey, coalesce(d.o_custkey, b.o_custkey) AS o_custkey, coalesce(d.o_orderstatus, b.o_orderstatus) AS o_orderstatus,
    CASE WHEN d.o_orderkey IS NOT NULL THEN d.o_totalprice ELSE b.o_totalprice END AS o_totalprice FROM base b LEFT JOIN delta d USING (o_orderkey)""")
def patch_by_key(spark, sf):
    base, delta = order_parts(spark, sf)
    return incremental.patch_by_key(base, delta, ["o_orderkey"], always=("o_totalprice",))


@query("cascade_delete", """SELECT 'customer' AS name, c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL
    SELECT 'orders', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def cascade_delete(spark, sf):
    customers = table(spark, sf, "customer")
    gone = customers.where("c_mktsegment = 'BUILDING'").select("c_custkey")
    left = incremental.cascade_delete(customers, "c_custkey", gone, {"orders": (table(spark, sf, "orders"), "o_custkey")})
    return left[""].select(F.lit("customer").alias("name"), F.col("c_custkey").alias("id")).unionByName(
        left["orders"].select(F.lit("orders").alias("name"), F.col("o_orderkey").alias("id")))


@query("skip_unchanged", """SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey > 12""")
def skip_unchanged(spark, sf):
    """Customers to redo: those never done, and those whose segment changed since."""
    customers = table(spark, sf, "customer")
    seen = ["c_name", "c_mktsegment"]
    before = customers.where("c_nationkey <= 12").withColumn(
        "c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "OLD").otherwise(F.col("c_mktsegment")))
    done = incremental.skip_unchanged(before, before, ["c_custkey"], seen, force=True).select("c_custkey", "fp")
    return incremental.skip_unchanged(customers, done, ["c_custkey"], seen).select("c_custkey", "c_name")


@query("apply_clip_edits", o.cte(
    ("clip", "SELECT o_orderkey AS clip_id, o_custkey AS start_ms, o_custkey + 20000 AS end_ms, o_orderpriority AS hook FROM orders"),
    ("edit", "SELECT l_orderkey AS clip_id, l_linenumber AS edit_ts, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey - 50 END AS s, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey + 30000 END AS e, l_shipdate::DATE::VARCHAR AS h FROM lineitem"),
    ("uq", "SELECT clip_id, edit_ts, max(s) AS s, max(e) AS e, max(h) AS h FROM edit GROUP BY ALL"),
    ("latest", "SELECT clip_id, arg_max(s, edit_ts) FILTER (WHERE s IS NOT NULL) AS s, arg_max(e, edit_ts) FILTER (WHERE e IS NOT NULL) AS e, arg_max(h, edit_ts) AS h FROM uq GROUP BY ALL"),
    ("done", "SELECT clip_id, CASE WHEN l.s IS NULL THEN start_ms ELSE greatest(0, l.s) END AS start_ms, coalesce(l.e, end_ms) AS end_ms, coalesce(l.h, hook) AS hook FROM clip LEFT JOIN latest l USING (clip_id)"),
) + " SELECT *, end_ms - start_ms AS duration_ms FROM done")
def apply_clip_edits(spark, sf):
    clips = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("clip_id"), F.col("o_custkey").alias("start_ms"), (F.col("o_custkey") + 20_000).alias("end_ms"),
        F.col("o_orderpriority").alias("hook"), F.lit("").alias("opening_text"), F.array(F.lit("x")).alias("emphasis_words"))
    n = F.col("l_linenumber")
    edits = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id"), n.alias("edit_ts")).agg(
        F.max(F.when(n % 2 == 0, F.col("l_suppkey") - 50)).alias("start_ms"),
        F.max(F.when(n % 3 == 0, F.col("l_partkey") + 30_000)).alias("end_ms"),
        F.max(F.col("l_shipdate").cast("date").cast("string")).alias("hook"))
    edits = edits.withColumns({"opening_text": F.lit(None).cast("string"), "emphasis_words": F.lit(None).cast("array<string>")})
    return incremental.apply_clip_edits(clips, edits).select("clip_id", "start_ms", "end_ms", "hook", "duration_ms")


# ----------------------------------------------------------------- catalog

@query("list_projects", """SELECT c.c_custkey, c.c_acctbal, n.n_name, count(o.o_orderkey) AS n_clips FROM
    (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100) c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
    LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL""")
def list_projects(spark, sf):
    """Customers as projects, their nation as the video, orders as clips."""
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    media = customers.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    clips = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    out = catalog.list_projects(customers, media, clips, key="c_custkey", created="c_acctbal")
    return out.select("c_custkey", "c_acctbal", "n_name", "n_clips")


@query("project_detail", o.cte(*CHOSEN_SQL) + """ SELECT d.doc_id, d.lang, coalesce(l.quality, -1) AS quality, count(b.clip_id) AS n_clips,
    coalesce(string_agg(b.clip_id, '|' ORDER BY b.index), '') AS clip_ids
    FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN best b ON b.transcript_id = d.doc_id GROUP BY ALL""")
def project_detail(spark, sf):
    docs = table(spark, sf, "documents")
    clips = chosen(spark, sf)[1].select(F.col("transcript_id").alias("doc_id"), "index", "clip_id", "score_overall")
    out = catalog.project_detail(docs.select("doc_id", "lang"), table(spark, sf, "labels"), docs.select("doc_id", "source"), clips, key="doc_id")
    return out.select("doc_id", "lang", F.coalesce("video.quality", F.lit(-1)).alias("quality"), F.size("clips").cast("bigint").alias("n_clips"),
                      F.array_join(F.transform("clips", lambda c: c["clip_id"]), "|").alias("clip_ids"))


STATE = {"O": "queued", "P": "processing", "F": "completed"}
JOBS_SQL = ("jobs", """SELECT o_orderkey AS job_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'processing' ELSE 'completed' END AS state,
    6 - left(o_orderpriority, 1)::INT AS priority, epoch(o_orderdate)::BIGINT AS created_at, CASE WHEN o_orderkey % 7 <> 0 THEN epoch(o_orderdate)::BIGINT + 60 END AS started FROM orders""")


def jobs(spark, sf) -> DataFrame:
    state = F.create_map(*[F.lit(x) for pair in STATE.items() for x in pair])
    created = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("project_id"),
        F.element_at(state, F.col("o_orderstatus")).alias("state"),
        (F.lit(6) - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), created.alias("created_at"),
        F.when(F.col("o_orderkey") % 7 != 0, F.timestamp_seconds(created + 60)).alias("started_at"))


@query("job_history", o.cte(JOBS_SQL) + " SELECT job_id, project_id, state, priority, created_at FROM jobs ORDER BY created_at DESC, job_id LIMIT 50")
def job_history(spark, sf):
    return catalog.job_history(jobs(spark, sf)).drop("started_at")


@query("job_queue", o.cte(JOBS_SQL) + " SELECT job_id, priority, created_at FROM jobs WHERE state = 'queued'")
def job_queue(spark, sf):
    return catalog.job_queue(jobs(spark, sf)).select("job_id", "priority", "created_at")


@query("stale_jobs", o.cte(JOBS_SQL) + """ SELECT job_id, project_id FROM jobs WHERE state = 'processing'
    AND (started IS NULL OR started < epoch(TIMESTAMP '1997-01-01 00:00:00') - 3600)""")
def stale_jobs(spark, sf):
    return catalog.stale_jobs(jobs(spark, sf), "1997-01-01 00:00:00").select("job_id", "project_id")


@query("coverage_warnings", """SELECT l_orderkey, l_linenumber, CASE WHEN dec < dur - 5000 THEN 'audio damaged: only the first ' || round_even(dec / 60000.0::DOUBLE, 0)::BIGINT || ' min decoded'
    WHEN tr > 0 AND tr < dur * 0.6 THEN 'speech found in only part of the source' ELSE '' END AS warnings FROM
    (SELECT l_orderkey, l_linenumber, l_partkey * 1000 AS dur, l_partkey * 1000 - l_suppkey * 100 AS dec, (l_partkey * 1000 * l_quantity / 50)::BIGINT AS tr FROM lineitem)""")
def coverage_warnings(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_partkey") * 1000).alias("duration_ms"),
        (F.col("l_partkey") * 1000 - F.col("l_suppkey") * 100).alias("decoded_ms"),
        (F.col("l_partkey") * 1000 * F.col("l_quantity") / 50).cast("bigint").alias("transcript_ms"))
    out = catalog.coverage_warnings(rows)
    return out.select("l_orderkey", "l_linenumber", F.array_join("warnings", "; ").alias("warnings"))


# ------------------------------------------------------- sources and sinks

@query("parse_media_probe", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'no video stream' WHEN p_size % 7 = 0 THEN 'missing duration or dimensions' ELSE '' END AS reject_reason,
    CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN -1 ELSE (CASE WHEN p_size % 2 = 0 THEN 1080 ELSE 1000 + p_size END)::INT END AS width,
    CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN -1 ELSE (CASE WHEN p_size % 2 = 0 THEN 1000 + p_size ELSE 1080 END)::INT END AS height,
    CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN -1 ELSE p_partkey * 1000 + 500 END AS duration_ms,
    CASE WHEN p_size % 5 = 0 OR p_size % 7 = 0 THEN -1 ELSE (CASE WHEN p_size % 3 = 0 THEN 30.0 ELSE 29.97 END)::DOUBLE END AS fps FROM part""")
def parse_media_probe(spark, sf):
    size = F.col("p_size")
    video = F.format_string(
        '{"codec_type": "video", "codec_name": "h264", "width": %d, "height": 1080, "avg_frame_rate": "%s", "side_data_list": [{"rotation": %d}]}',
        size + 1000, F.when(size % 3 == 0, "0/0").otherwise("30000/1001"), F.when(size % 2 == 0, -90).otherwise(0))
    text = F.format_string(
        '{"format": {"duration": "%s", "size": "99", "format_name": "mov,mp4"}, "streams": [{"codec_type": "audio", "channels": 2}%s]}',
        F.when(size % 7 == 0, "0").otherwise(F.concat(F.col("p_partkey").cast("string"), F.lit(".5"))),
        F.when(size % 5 == 0, "").otherwise(F.concat(F.lit(", "), video)))
    good, bad = probe.parse_media_probe(table(spark, sf, "part").select("p_partkey", text.alias("json")))
    kept = good.select("p_partkey", F.lit("").alias("reject_reason"), "width", "height", "duration_ms", "fps")
    none = {c: F.lit(-1).cast(t) for c, t in kept.dtypes[2:]}
    return kept.unionByName(bad.select("p_partkey", "reject_reason").withColumns(none))


@query("read_transcripts", """SELECT conv_id::VARCHAR AS conv, turn AS seg_idx, turn * 1500 AS start_ms, turn * 1500 + 1250 AS end_ms, text, 'en' AS language FROM conversations""")
def read_transcripts(spark, sf):
    """Conversations written as one JSON document each, and read back with defaults."""
    turn = F.struct("turn", (F.col("turn") * 1.5).alias("start"), (F.col("turn") * 1.5 + 1.25).alias("end"), "text")
    docs = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("segments"))
    path = own(spark, f"{shared_dir(spark)}/momentloom/docs-{uuid.uuid4().hex}") + "/docs"
    body = F.to_json(F.struct(F.col("conv_id").cast("string").alias("model"), "segments"))
    docs.select(body.alias("value")).write.text(path)
    _, segs = docs_in.read_transcripts(spark, path, multi_line=False, id_field="model")
    return segs.select(F.col("transcript_id").alias("conv"), "seg_idx", "start_ms", "end_ms", "text", "language")


@query("read_token_json", o.cte(
    ("w", f"SELECT conv_id, turn, {o.numbered('''string_split(text, ' ')''', 'word', 'i')} FROM conversations"),
) + """ SELECT conv_id::VARCHAR AS transcript_id, turn AS seg_idx, i AS word_idx, trim(word, ' ' || chr(10)) AS text, i * 10 AS start_ms, (i * 10 + 5) AS end_ms,
    CASE WHEN i % 2 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS prob FROM w WHERE trim(word, ' ' || chr(10)) <> '' AND i > 0""")
def read_token_json(spark, sf):
    """Words of each turn as recogniser tokens, written as documents and read back; the first is
    a control token. The language field carries the document's id."""
    parts = F.split("text", " ")
    token = F.transform(parts, lambda t, i: F.struct(
        F.when(i == 0, F.lit("[_BEG_]")).otherwise(t).alias("text"),
        F.struct((i * 10).cast("bigint").alias("from"), (i * 10 + 5).cast("bigint").alias("to")).alias("offsets"),
        F.when(i % 2 == 0, F.lit(0.5)).otherwise(F.lit(0.0)).alias("p")))
    piece = F.struct(F.struct(F.lit(0).cast("bigint").alias("from"), F.lit(100).cast("bigint").alias("to")).alias("offsets"), "text", token.alias("tokens"))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", piece.alias("p"))
    named = F.struct(F.concat_ws("-", "conv_id", "turn").alias("language"))
    path = own(spark, f"{shared_dir(spark)}/momentloom/tokens-{uuid.uuid4().hex}") + "/tokens"
    turns.select(F.to_json(F.struct(named.alias("result"), F.array("p").alias("transcription"))).alias("value")).write.text(path)
    heads, segs = docs_in.read_token_json(spark, path, multi_line=False, id_field="result.language")
    spoken = heads.where("has_word_timestamps and n_segments = 1").select("transcript_id")
    at = F.split("transcript_id", "-")
    rows = segs.join(spoken, "transcript_id", "left_semi").select(at[0].alias("transcript_id"), at[1].cast("bigint").alias("seg_idx"), F.explode_outer("words").alias("w"))
    start = F.col("w.start_ms")
    return rows.where("w is not null").select(
        "transcript_id", "seg_idx", (start / 10).cast("bigint").alias("word_idx"), "w.text", "w.start_ms", "w.end_ms", "w.prob")


def srt_stamp(ms: str) -> str:
    return (f"lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} // 60000 % 60)::VARCHAR, 2, '0') || ':' || "
            f"lpad(({ms} // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad(({ms} % 1000)::VARCHAR, 3, '0')")


@query("srt_documents", o.cte(*REFINED_SQL,
    ("rel", "SELECT clip_id, n, greatest(0, seg_start - start_ms) AS s, seg_end - start_ms AS e, text FROM clip_rows"),
    ("blocks", f"SELECT clip_id, n, (n + 1) || chr(10) || {srt_stamp('s')} || ' --> ' || {srt_stamp('greatest(s + 200, e)')} || chr(10) || text AS b FROM rel"),
) + " SELECT clip_id, string_agg(b, chr(10) || chr(10) ORDER BY n) || chr(10) AS srt FROM blocks GROUP BY clip_id")
def srt_documents(spark, sf):
    """Bodies written in bulk and read back."""
    path = own(spark, f"{shared_dir(spark)}/momentloom/srt-{uuid.uuid4().hex}") + "/srt"
    sinks.write_srt(refined_clips(spark, sf), path)
    return spark.read.parquet(path)


@query("analyze", o.cte(*CHOSEN_SQL, *o.refined()[:6],
    ("lengths", "SELECT transcript_id, max(end_ms) AS duration FROM sents GROUP BY ALL"),
    ("padded", "SELECT clip_id, duration, greatest(0, t0 - 350) AS r0, least(duration, t1 + 350) AS r1 FROM ends JOIN lengths USING (transcript_id)"),
    ("fin", "SELECT clip_id, r0 AS start_ms, CASE WHEN r1 - r0 < 12000 THEN least(duration, r0 + 12000) ELSE r1 END AS end_ms FROM padded"),
) + " SELECT b.transcript_id, b.index, b.clip_id, f.start_ms, f.end_ms, b.score_overall, 'Seeded by: ' || b.seed_reason AS reason FROM best b JOIN fin f USING (clip_id)")
def analyze(spark, sf):
    """The whole chain: segments in, ranked clips out."""
    out = an.analyze(doc_segments(spark, sf), lex=SAMPLE).clips
    return out.select("transcript_id", "index", "clip_id", "start_ms", "end_ms", "score_overall", "reason")


DOCUMENT = ("transcript_id string, language string, audio_seconds double, n_candidates bigint, n_unique bigint, llm_used boolean, "
            "options struct<n_clips:int>, warnings array<string>, clips array<struct<index:int,start:double,end:double,duration:double,"
            "text:string,score:struct<overall:int>,reason:string,category:string>>")


@query("analysis_documents", o.cte(*CHOSEN_SQL, *o.refined()[:6],
    ("lengths", "SELECT transcript_id, max(end_ms) AS duration FROM sents GROUP BY ALL"),
    ("padded", "SELECT clip_id, duration, greatest(0, t0 - 350) AS r0, least(duration, t1 + 350) AS r1 FROM ends JOIN lengths USING (transcript_id)"),
    ("fin", "SELECT clip_id, r0 AS s, CASE WHEN r1 - r0 < 12000 THEN least(duration, r0 + 12000) ELSE r1 END AS e FROM padded"),
    ("made", "SELECT transcript_id, count(*) AS n_candidates FROM adjusted GROUP BY ALL"),
    ("distinct_n", "SELECT transcript_id, count(*) AS n_unique FROM uniq GROUP BY ALL"),
) + """ SELECT m.transcript_id, 'en' AS language, duration / 1000.0::DOUBLE AS audio_seconds, n_candidates, coalesce(n_unique, 0)::BIGINT AS n_unique,
    false AS llm_used, 5 AS n_clips, CASE WHEN duration < 20000 THEN 'short source' ELSE '' END AS warnings,
    coalesce(b.index, 0)::INT AS index, coalesce(f.s, -1000) / 1000.0::DOUBLE AS start, coalesce(f.e, -1000) / 1000.0::DOUBLE AS "end",
    coalesce(b.score_overall, -1)::INT AS overall, coalesce('Seeded by: ' || b.seed_reason, '') AS reason
    FROM made m JOIN lengths USING (transcript_id) LEFT JOIN distinct_n USING (transcript_id)
    LEFT JOIN best b USING (transcript_id) LEFT JOIN fin f USING (clip_id)""")
def analysis_documents(spark, sf):
    """Documents written to files and read back into columns."""
    segments = doc_segments(spark, sf)
    done = an.analyze(segments, lex=SAMPLE)
    lengths = done.sentences.groupBy("transcript_id").agg(F.max("end_ms").alias("duration_ms"))
    heads = lengths.withColumn("language", F.lit("en"))
    warned = lengths.select("transcript_id", F.when(
        F.col("duration_ms") < 20_000, F.array(F.lit("short source"))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    path = own(spark, f"{shared_dir(spark)}/momentloom/analysis-{uuid.uuid4().hex}") + "/documents"
    sinks.write_analysis(sinks.analysis_documents(done.clips, done.stats, heads=heads, warnings=warned, options={"n_clips": 5}), path)
    back = spark.read.text(path).select(F.from_json("value", DOCUMENT).alias("d")).select("d.*")
    none = F.lit(-1.0)
    return back.select("*", F.explode_outer("clips").alias("c")).select(
        F.col("transcript_id").cast("bigint").alias("transcript_id"), "language", "audio_seconds", "n_candidates", "n_unique",
        "llm_used", "options.n_clips", F.array_join("warnings", "|").alias("warnings"), F.coalesce("c.index", F.lit(0)).alias("index"),
        F.coalesce("c.start", none).alias("start"), F.coalesce("c.end", none).alias("end"),
        F.coalesce("c.score.overall", F.lit(-1)).alias("overall"), F.coalesce("c.reason", F.lit("")).alias("reason"))


def judge(prompt: str) -> str:
    """A stand-in scorer: the length of each entry; it fails where the listing's length is a
    multiple of five."""
    listing = prompt.split("\n\n", 1)[1]
    if len(listing) % 5 == 0:
        raise ValueError("cannot judge this")
    rows = ", ".join(f'{{"index": {i}, "score": {len(e) % 101}, "category": "Advice"}}' for i, e in enumerate(listing.split("\n\n[")))
    return "```json\n[" + rows + "]\n```"


EVALUATED_SQL = [
    *o.chain(SAMPLE)[:-1],
    ("entries", """SELECT transcript_id, seed_rank, target_ord, place, (place // 6)::BIGINT AS batch, '[' || (place % 6) || '] (' || round_even((end_ms - start_ms) / 1000.0::DOUBLE, 0)::BIGINT || 's) ' || text AS entry
        FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY seed_rank, target_ord) - 1 AS place FROM cands)"""),
    ("listings", "SELECT transcript_id, batch, string_agg(entry, chr(10) || chr(10) ORDER BY place) AS listing FROM entries GROUP BY ALL"),
    ("answers", """SELECT transcript_id, seed_rank, target_ord, CASE WHEN length(listing) % 5 <> 0 THEN (length(entry) - CASE WHEN place % 6 = 0 THEN 0 ELSE 1 END) % 101 END AS eval_score
        FROM entries JOIN listings USING (transcript_id, batch)"""),
    ("judged", "SELECT s.*, eval_score FROM scored s JOIN answers USING (transcript_id, seed_rank, target_ord)"),
    ("blended", f"SELECT * REPLACE (CASE WHEN eval_score IS NULL THEN score_overall ELSE {o.clamp('0.5::DOUBLE * score_overall + 0.5::DOUBLE * eval_score')} END AS score_overall) FROM judged"),
    o.adjusted("blended"),
    *o.dedup(o.LEVELS, n=5), o.top_n(5),
]


@query("analyze_with_evaluations", o.cte(*EVALUATED_SQL,
    ("used", "SELECT transcript_id, bool_or(eval_score IS NOT NULL) AS any_used FROM judged GROUP BY ALL"),
) + """ SELECT b.transcript_id, b.index, b.clip_id, b.score_overall, b.eval_score IS NOT NULL AS llm_used,
    CASE WHEN b.eval_score IS NULL THEN 'insight' ELSE 'advice' END AS category, u.any_used FROM best b JOIN used u USING (transcript_id)""")
def analyze_with_evaluations(spark, sf):
    """The chain with a scorer: batches that fail keep their rule scores."""
    done = an.analyze(doc_segments(spark, sf), lex=SAMPLE, scorer=judge)
    used = done.stats.select("transcript_id", F.col("llm_used").alias("any_used"))
    return done.clips.join(used, "transcript_id").select(
        "transcript_id", "index", "clip_id", "score_overall", "llm_used", "category", "any_used")


@query("hook_answers", """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'Hook ' || d.doc_id ELSE d.source END AS hook,
    CASE WHEN d.doc_id % 3 = 0 AND d.doc_id % 2 = 0 THEN 'Alt ' || d.doc_id ELSE 'old alt' END AS alt_hook, 'old opening' AS opening_text FROM documents d""")
def hook_answers(spark, sf):
    """Answers to a second question, with stale and empty ones among them."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("hook"))
    clips = docs.withColumns({"alt_hook": F.lit("old alt"), "opening_text": F.lit("old opening")})
    doc = F.col("doc_id")
    fresh = F.format_string('```json\n{"hook": "%s%d", "altHook": "%s", "opening_text": 5}\n```',
                            F.lit("Hook "), doc, F.when(doc % 2 == 0, F.format_string("Alt %d", doc)).otherwise(""))
    stale = F.lit('{"hook": "stale", "alt_hook": "stale", "opening_text": "stale"}')
    empty = F.lit('{"hook": "", "alt_hook": "lost"}')
    raw = docs.select("doc_id", F.lit(2).alias("at"), F.when(doc % 3 == 0, fresh).otherwise(empty).alias("raw")).unionByName(
        docs.select("doc_id", F.lit(1).alias("at"), stale.alias("raw")))
    read = evals.validate_hooks(evals.parse_eval_responses(raw).drop("raw"))
    return evals.merge_hooks(clips, read, ["doc_id"], "at")


@query("clip_cues", o.cte(*CUES_SQL,
    ("counted", "SELECT clip_id, count(*) AS n_words FROM clip_words GROUP BY ALL"),
    ("wordless", """SELECT r.*, list_filter(regexp_split_to_array(r.text, '\\s+'), lambda t: t <> '') AS t, greatest(0, r.seg_start - r.start_ms)::DOUBLE AS s
        FROM clip_rows r LEFT JOIN counted c USING (clip_id) WHERE coalesce(n_words, 0) < 2"""),
    ("lasting", "SELECT *, greatest(s + 300.0::DOUBLE, (seg_end - start_ms)::DOUBLE) AS e, (len(t) + 2) // 3 AS parts FROM wordless WHERE len(t) > 0"),
    ("parted", "SELECT *, unnest(range(0, parts)) AS part, (e - s) / parts AS dur FROM lasting"),
    ("plain_parts", """SELECT clip_id, (row_number() OVER (PARTITION BY clip_id ORDER BY n, part) - 1)::INT AS cue_idx,
        round_even(s + part * dur, 0)::BIGINT AS start_ms, round_even(s + part * dur + dur, 0)::BIGINT AS end_ms FROM parted"""),
) + """ SELECT c.clip_id, c.cue_idx, c.start_ms, c.end_ms, 'words' AS source FROM cues c JOIN counted USING (clip_id) WHERE n_words >= 2
    UNION ALL SELECT clip_id, cue_idx, start_ms, end_ms, 'segments' AS source FROM plain_parts""")
def choose_cues(spark, sf):
    """Word cues where a clip has at least two word times, else cues of its segments."""
    return cues.clip_cues(refined_clips(spark, sf), 3).select("clip_id", "cue_idx", "start_ms", "end_ms", "source")


# --------------------------------------------------------------- streaming

def event_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_pause_blocks", o.cte(
    ("e", "SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + event_id % 4 * 600000000 AS e FROM events"),
    ("p", "SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e"),
    ("b", f"SELECT *, sum(CASE WHEN reach IS NULL OR s - reach >= 1000 * {6 * HOUR}::BIGINT THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM p"),
    ("c", "SELECT user_id, count(*) AS n_rows, min(s) AS first_start, max(s) AS last_start, max(e) AS e FROM b GROUP BY user_id, g"),
) + f" SELECT user_id, n_rows, first_start, last_start FROM c WHERE e + 1000 * ({6 * HOUR}::BIGINT - 1) <= (SELECT max(s) // 1000 * 1000 - 10000000 FROM e)")
def stream_blocks(spark, sf):
    """The blocks that the watermark has closed when the input ends."""
    stream = event_stream(spark, sf).withColumn("duration_ms", F.col("event_id") % 4 * 600_000)
    out = closed_rows(stream_pause_blocks(stream, "user_id", "ts", "duration_ms", 6 * HOUR))
    return out.withColumns({c: F.unix_micros(c) for c in ("first_start", "last_start")})


@query("latest_job_state", """SELECT user_id, epoch_us(max(ts)) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id""")
def latest_state(spark, sf):
    out = latest_rows(latest_job_state(event_stream(spark, sf), "user_id", "ts", ["event_type", "value"], "event_id"), ["user_id"])
    return out.withColumn("ts", F.unix_micros("ts"))


@query("stream_blocks_in_order", o.cte(
    ("e", "SELECT user_id, event_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + event_id % 4 * 28800000 AS e FROM events"),
    ("f", "SELECT *, (SELECT max(s) - 10000 FROM e) AS mark FROM e"),
    ("p", "SELECT *, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS before FROM f WHERE s < mark"),
    ("b", f"SELECT *, sum((before IS NULL OR s - before >= {6 * HOUR})::INT) OVER (PARTITION BY user_id ORDER BY s, event_id) AS g FROM p"),
    ("c", """SELECT user_id, g, max(g) OVER (PARTITION BY user_id) AS open, count(*) AS n_rows, min(s) AS first_start, max(s) AS last_start,
        arg_max(e, (s, event_id)) AS ended, any_value(mark) AS mark FROM b GROUP BY user_id, g"""),
) + f" SELECT user_id, n_rows, first_start, last_start FROM c WHERE g < open OR mark - ended >= {6 * HOUR}")
def stream_ordered_blocks(spark, sf):
    """Blocks by the previous row's end, with rows that overlap; those closed when the input ends."""
    stream = event_stream(spark, sf).withColumn("duration_ms", F.col("event_id") % 4 * 28_800_000)
    out = closed_rows(stream_blocks_in_order(stream, "user_id", "ts", "duration_ms", "event_id", 6 * HOUR))
    return out.withColumns({c: F.unix_millis(c) for c in ("first_start", "last_start")})


@query("expiring_job_state", ORACLES["latest_job_state"])
def expiring_state(spark, sf):
    """The latest state again, where users leave the state a day after a purchase."""
    state = expiring_job_state(event_stream(spark, sf), "user_id", "ts", ["event_type", "value"], "event_id",
                               F.col("event_type") == "purchase", DAY)
    return latest_rows(state, ["user_id"]).withColumn("ts", F.unix_micros("ts"))
