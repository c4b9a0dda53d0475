"""Text rules as native column expressions (no UDFs).

Patterns run with ``(?U)`` so that word and space classes are Unicode on every
JDK. Word counts and tokens stay ASCII on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentloom.functions import lexicon as lx

SPACES = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
WORD = "[A-Za-z0-9']+"

# After terminal punctuation, unless a lone dot closes an abbreviation; then whitespace.
SENTENCE_END = (
    r"(?iU)(?<=[.!?])(?<!(?<![A-Za-z.])(?:"
    + "|".join(re.escape(a) for a in lx.ABBREVIATIONS)
    + r")\.)"
)
SENTENCE_BREAK = SENTENCE_END + r"\s+"
CONNECTIVE_REACH = max(map(len, re.findall("[a-z]+", lx.TRAILING_CONNECTIVE))) + 1  # with the character before
SENTENCE_REACH = max(map(len, lx.ABBREVIATIONS)) + 2  # characters that a break looks back


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: Column | str) -> Column:
    """Remove surrounding whitespace of any kind (``trim`` handles blanks only)."""
    return F.btrim(_c(col), F.lit(SPACES))


def matches(col: Column | str, pattern: str) -> Column:
    return _c(col).rlike("(?iU)" + pattern)


def word_count(col: Column | str) -> Column:
    return F.regexp_count(_c(col), F.lit(WORD))


def tokens(col: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(WORD), F.lit(0))


def filler_count(col: Column | str, lex: lx.Lexicon = lx.DEFAULT) -> Column:
    return F.regexp_count(_c(col), F.lit("(?iU)" + lex.filler))


def filler_ratio(
    col: Column | str, lex: lx.Lexicon = lx.DEFAULT, words: Column | None = None, fillers: Column | None = None
) -> Column:
    """Weighted share of filler words, at most 1; pass ``words`` and ``fillers`` if already counted."""
    words = word_count(col) if words is None else words
    fillers = filler_count(col, lex) if fillers is None else fillers
    ratio = F.least(F.lit(1.0), fillers / F.greatest(F.lit(1), words) * F.lit(3.0))
    return F.when(words == 0, F.lit(1.0)).otherwise(ratio)


def starts_awkwardly(col: Column | str) -> Column:
    return matches(strip(col), lx.LEADING_FILLER)


def strip_leading_filler(col: Column | str) -> Column:
    """Drop one opening filler word, unless nothing else would be left."""
    whole = strip(col)
    rest = strip(F.regexp_replace(whole, "(?iU)" + lx.LEADING_FILLER, ""))
    return F.coalesce(F.nullif(rest, F.lit("")), whole)


def looks_incomplete(col: Column | str) -> Column:
    """No closing punctuation, or the last word leaves the thought open."""
    whole = strip(col)
    closed = F.right(whole, F.lit(2)).rlike(r"[.!?]['\"]?\z")
    # The last word alone decides, so the pattern need not run along the text.
    tail = F.right(F.rtrim(whole, F.lit(".!?")), F.lit(CONNECTIVE_REACH))
    return ~closed | matches(tail, lx.TRAILING_CONNECTIVE + r"\z")


def has_any_token(col: Column | str, words: tuple[str, ...]) -> Column:
    """True when a lower-cased token equals one of ``words``."""
    options = "|".join(re.escape(w) for w in words)
    return _c(col).rlike(f"(?i)(?<![A-Za-z0-9'])(?:{options})(?![A-Za-z0-9'])")


def feature_flags(col: Column | str, lex: lx.Lexicon = lx.DEFAULT) -> dict[str, Column]:
    """The seven lexical signals of a text, keyed by name."""
    return {
        "question": strip(col).endswith("?") | matches(col, lex.question),
        "number": matches(col, lex.number),
        "contrast": matches(col, lex.contrast),
        "emotion": has_any_token(col, lex.emotion_words),
        "strong_claim": matches(col, lex.strong_claim),
        "story": matches(col, lex.story),
        "actionable": matches(col, lex.actionable),
    }


def sentences(col: Column | str) -> Column:
    """Array of the sentences of a text; terminal punctuation stays attached."""
    pieces = F.transform(F.split(strip(col), SENTENCE_BREAK), strip)
    return F.filter(pieces, lambda s: s != "")


def annotate_text(
    df: DataFrame, col: str = "text", lex: lx.Lexicon = lx.DEFAULT, prefix: str = ""
) -> DataFrame:
    """Add word count, filler ratio, opening/closing checks and the seven flags.

    A ``facts`` column (``text_facts`` of the same lexicon) saves the patterns where it is not null.
    """
    def known(name: str, found: Column) -> Column:
        return F.coalesce(F.col("facts")[name], found) if "facts" in df.columns else found

    words = prefix + "word_count"
    return df.withColumn(words, known("word_count", word_count(col))).withColumns({
        prefix + "filler_ratio": filler_ratio(col, lex, F.col(words), known("fillers", filler_count(col, lex))),
        prefix + "starts_awkwardly": known("starts_awkwardly", starts_awkwardly(col)),
        prefix + "looks_incomplete": known("looks_incomplete", looks_incomplete(col)),
        **{prefix + name: known(name, flag) for name, flag in feature_flags(col, lex).items()},
    })


def text_facts(col: Column | str, lex: lx.Lexicon = lx.DEFAULT) -> Column:
    """What ``annotate_text`` finds in a sentence, and what ``joined_facts`` needs to add sentences up."""
    text = _c(col)
    clean = (text != "") & (strip(text) == text)
    return F.struct(
        word_count(text).alias("word_count"), filler_count(text, lex).alias("fillers"),
        starts_awkwardly(text).alias("starts_awkwardly"), looks_incomplete(text).alias("looks_incomplete"),
        *[flag.alias(name) for name, flag in feature_flags(text, lex).items()],
        matches(text, lex.question).alias("asks"), clean.alias("clean"),
        (clean & F.right(text, F.lit(2)).rlike(r"[.!?]['\"]?\z")).alias("closed"),
    )


def separable(lex: lx.Lexicon) -> bool:
    """True when no pattern can match across a closing mark and the blank after it.

    So it is for words, numbers and phrases of words between word borders, and for the default
    patterns: what they match before a blank is a letter, and a number needs none of its unit.
    """
    patterns = (lex.question, lex.number, lex.contrast, lex.strong_claim, lex.story, lex.actionable, lex.filler)
    fixed = (lx.QUESTION, lx.NUMBER, lx.CONTRAST, lx.STRONG_CLAIM, lx.STORY, lx.ACTIONABLE, lx.FILLER)
    plain = re.compile(r"\\b\((?:[a-z' |]|\\d\+)+\)\\b")
    return all(p in fixed or plain.fullmatch(p) for p in patterns) and all(
        re.fullmatch("[a-z']+", w) for w in lex.emotion_words)


def joined_facts(parts: Column) -> Column:
    """``text_facts`` of sentences joined by blanks, from the facts of an array of them.

    Null unless every sentence but the last is closed, where patterns of a ``separable`` lexicon
    match inside one sentence only.
    """
    last = F.element_at(parts, -1)

    def total(name: str) -> Column:
        return F.aggregate(parts, F.lit(0), lambda n, x: n + x[name])

    def some(name: str) -> Column:
        return F.exists(parts, lambda x: x[name])

    names = [n for n in lx.FLAGS if n != "question"]
    whole = F.struct(
        total("word_count").alias("word_count"), total("fillers").alias("fillers"),
        F.get(parts, F.lit(0))["starts_awkwardly"].alias("starts_awkwardly"), last["looks_incomplete"].alias("looks_incomplete"),
        (some("asks") | last["question"]).alias("question"),
        *[some(n).alias(n) for n in names],
    )
    apart = F.forall(F.slice(parts, 1, F.size(parts) - 1), lambda x: x["closed"]) & last["clean"]
    return F.when((F.size(parts) > 0) & apart, whole)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays read as sets; 0 when either is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / both
    )


def text_jaccard(a: Column | str, b: Column | str) -> Column:
    return jaccard(tokens(a), tokens(b))


def shorten(col: Column, limit: int) -> Column:
    """Cut a text longer than ``limit`` at the last blank, and mark the cut."""
    cut = F.regexp_replace(F.substring(col, 1, limit - 3), r"(?s) [^ ]*\z", "")
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(cut, F.lit("…")))
