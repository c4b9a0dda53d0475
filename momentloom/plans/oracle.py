"""DuckDB SQL that states each registered query independently.

Pieces are built as strings: word boundaries are ASCII in that engine, so texts are
first folded (every character outside ASCII becomes a letter no pattern uses), and a
look-behind is expressed with marker characters.
"""

from __future__ import annotations

import re

from momentloom.functions import lexicon as lx

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def fold(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', 'j', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({fold(x)}, {q('(?i)' + pattern)})"


def words(x: str) -> str:
    return f"len(regexp_extract_all({x}, {q(r'[A-Za-z0-9' + chr(39) + ']+')}))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {q(r'[a-z0-9' + chr(39) + ']+')})"


def filler(x: str, lex: lx.Lexicon = lx.DEFAULT) -> str:
    n = f"len(regexp_extract_all({fold(x)}, {q('(?i)' + lex.filler)}))"
    return f"(CASE WHEN {words(x)} = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, {n} / greatest(1, {words(x)}) * 3.0::DOUBLE) END)"


def awkward(x: str) -> str:
    return has(strip(x), lx.LEADING_FILLER)


def strip_filler(x: str) -> str:
    # Two letters of the fold keep the length, so the cut is taken on the original.
    cut = f"regexp_extract({fold(strip(x))}, {q('(?i)' + lx.LEADING_FILLER)})"
    rest = strip(f"substr({strip(x)}, len({cut}) + 1)")
    return f"coalesce(nullif({rest}, ''), {strip(x)})"


def incomplete(x: str) -> str:
    closed = f"regexp_matches({strip(x)}, {q('[.!?][' + chr(39) + chr(34) + ']?$')})"
    return f"(NOT {closed} OR {has(strip(x), lx.TRAILING_CONNECTIVE + r'[.!?]*$')})"


def token_of(x: str, options: tuple[str, ...]) -> str:
    any_of = "|".join(re.escape(o) for o in options)
    return f"regexp_matches({x}, {q('(?i)(^|[^A-Za-z0-9' + chr(39) + '])(' + any_of + ')($|[^A-Za-z0-9' + chr(39) + '])')})"


def flags(x: str, lex: lx.Lexicon) -> dict[str, str]:
    return {
        "question": f"(suffix({strip(x)}, '?') OR {has(x, lex.question)})",
        "number": has(x, lex.number),
        "contrast": has(x, lex.contrast),
        "emotion": token_of(x, lex.emotion_words),
        "strong_claim": has(x, lex.strong_claim),
        "story": has(x, lex.story),
        "actionable": has(x, lex.actionable),
    }


def flag_columns(x: str, lex: lx.Lexicon) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in flags(x, lex).items())


def annotation(x: str, lex: lx.Lexicon) -> str:
    return (
        f"{words(x)}::INT AS word_count, {filler(x, lex)} AS filler_ratio, {awkward(x)} AS starts_awkwardly, "
        f"{incomplete(x)} AS looks_incomplete, {flag_columns(x, lex)}"
    )


def sentences(x: str) -> str:
    names = "|".join(re.escape(a) for a in lx.ABBREVIATIONS)
    marked = f"regexp_replace({strip(x)}, '([.!?])(\\s+)', '\\1' || chr(1) || '\\2', 'g')"
    undone = f"regexp_replace({marked}, '(?i)(^|[^A-Za-z.])({names})\\.' || chr(1), '\\1\\2.', 'g')"
    return f"list_filter(list_transform(string_split({undone}, chr(1)), lambda p: {strip('p')}), lambda p: p <> '')"


def numbered(array: str, item: str, pos: str) -> str:
    return f"unnest({array}) AS {item}, generate_subscripts({array}, 1) - 1 AS {pos}"


def cte(*parts: tuple[str, str]) -> str:
    """Named steps; every step that does not call itself is evaluated once."""
    def one(name: str, body: str) -> str:
        recursive = re.search(rf"FROM {name}\b", body) is not None
        return f"{name} AS {'' if recursive else 'MATERIALIZED '}({body})"

    return "WITH RECURSIVE " + ",\n".join(one(n, b) for n, b in parts)


# ---------------------------------------------------------------- base tables

LINES = [
    ("raw_lines", "SELECT doc_id AS transcript_id, string_split(text, chr(10)) AS a FROM documents"),
    ("one_line", f"SELECT transcript_id, {numbered('a', 'line', 'seg_idx')} FROM raw_lines"),
    ("lines", f"SELECT transcript_id, seg_idx, {strip('line')} AS text FROM one_line WHERE {strip('line')} <> ''"),
]
TURNS = [
    ("lines", f"SELECT conv_id AS transcript_id, turn AS seg_idx, {strip('text')} AS text FROM conversations WHERE {strip('text')} <> ''"),
]
CLOCK = [
    ("paced", f"""SELECT *, greatest(200, {words('text')} * 400) AS dur,
        (CASE seg_idx % 4 WHEN 0 THEN 300 WHEN 1 THEN 700 WHEN 2 THEN 1100 ELSE 1500 END) AS pause FROM lines"""),
    ("summed", """SELECT *, sum(dur + pause) OVER w - first_value(pause) OVER w AS end_ms
        FROM paced WINDOW w AS (PARTITION BY transcript_id ORDER BY seg_idx)"""),
    ("segs", "SELECT transcript_id, seg_idx, (end_ms - dur)::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, text FROM summed"),
]
TIMED = [
    ("arrays", f"SELECT *, {sentences('text')} AS parts FROM segs"),
    ("pieces", f"""SELECT transcript_id, seg_idx, start_ms::DOUBLE AS lo, end_ms::DOUBLE AS hi, length(text) AS n_chars,
        len(parts) AS n, {numbered('parts', 'text', 'pos')} FROM arrays WHERE len(parts) > 0"""),
    ("reached", """SELECT *, sum(length(text)) OVER (PARTITION BY transcript_id, seg_idx ORDER BY pos) AS cum FROM pieces"""),
    ("spans", """SELECT *, CASE WHEN pos = 0 THEN lo ELSE least(hi, lo + (hi - lo) * (cum - length(text)) / n_chars) END AS s,
        CASE WHEN pos = n - 1 THEN hi ELSE least(hi, lo + (hi - lo) * cum / n_chars) END AS e FROM reached"""),
    ("rounded", """SELECT transcript_id, seg_idx, pos, text, round_even(s, 0)::BIGINT AS start_ms,
        round_even(greatest(e, s + 200), 0)::BIGINT AS end_ms FROM spans"""),
    ("gapped", """SELECT *, row_number() OVER w - 1 AS idx,
        greatest(0, coalesce(start_ms - lag(end_ms) OVER w, 0)) AS gap_before_ms
        FROM rounded WINDOW w AS (PARTITION BY transcript_id ORDER BY seg_idx, pos)"""),
    ("sents", """SELECT *, (sum((gap_before_ms >= 1200)::INT) OVER (PARTITION BY transcript_id ORDER BY idx))::BIGINT AS block FROM gapped"""),
]
SENTS = LINES + CLOCK + TIMED
WORD_TIMED = [
    ("pieces", f"""SELECT c.*, c.end_ms::DOUBLE AS hi, a.n_words IS NOT NULL AS mapped, a.first_word * 400 + c.start_ms AS run_start,
        (a.first_word + a.n_words - 1) * 400 + 350 + c.start_ms AS run_end FROM
        (SELECT transcript_id, seg_idx, start_ms, end_ms, length(text) AS n_chars, len(parts) AS n, {numbered('parts', 'text', 'pos')}
         FROM said WHERE len(parts) > 0) c LEFT JOIN aligned a USING (transcript_id, seg_idx, pos)"""),
    ("grouped", "SELECT *, sum(mapped::INT) OVER (PARTITION BY transcript_id, seg_idx ORDER BY pos) AS g FROM pieces"),
    ("reached", """SELECT *, sum(CASE WHEN mapped THEN 0 ELSE length(text) END) OVER w AS cum,
        coalesce(first_value(run_end) OVER w, start_ms)::DOUBLE AS lo
        FROM grouped WINDOW w AS (PARTITION BY transcript_id, seg_idx, g ORDER BY pos)"""),
    ("spans", """SELECT *, CASE WHEN mapped THEN run_start::DOUBLE WHEN cum = length(text) THEN lo
            ELSE least(hi, lo + (hi - start_ms::DOUBLE) * (cum - length(text)) / n_chars) END AS s,
        CASE WHEN mapped THEN run_end::DOUBLE WHEN pos = n - 1 THEN hi ELSE least(hi, lo + (hi - start_ms::DOUBLE) * cum / n_chars) END AS e FROM reached"""),
    *TIMED[4:],
]


def heard() -> list[tuple[str, str]]:
    """Lines with words on an even clock, and the best run of words of each sentence by brute force."""
    def pieces(x: str) -> str:
        return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda t: t <> '')"

    return [
        ("said", f"""SELECT transcript_id, seg_idx, start_ms, end_ms, text, {sentences('text')} AS parts, {pieces('text')} AS toks FROM segs"""),
        ("spoken", """SELECT * EXCLUDE (toks), list_transform(toks, lambda t, i: trim(lower(CASE WHEN (seg_idx + i - 1) % 9 = 8 THEN 'x' || t ELSE t END), '.,!?;:')) AS w
            FROM said WHERE seg_idx % 5 <> 4 AND len(parts) > 1 AND len(toks) > 0"""),
        ("asked", f"SELECT transcript_id, seg_idx, w, {numbered('parts', 'sentence', 'pos')} FROM spoken"),
        ("goals", f"""SELECT transcript_id, seg_idx, w, pos, len(a) AS n,
            list_distinct(list_filter(list_transform(a, lambda t: trim(t, '.,!?;:')), lambda t: t <> '')) AS goal
            FROM (SELECT *, {pieces('lower(sentence)')} AS a FROM asked)"""),
        ("tried", """SELECT transcript_id, seg_idx, pos, goal, i, r, n + d AS span, list_distinct(list_filter(w[i + 1 : i + n + d], lambda t: t <> '')) AS run
            FROM (SELECT * FROM (SELECT *, unnest(range(0, len(w))) AS i FROM goals)
                WHERE len(list_intersect(w[i + 1 : i + n + 2], goal)) >= 0.54::DOUBLE * len(goal)), (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) l(r, d)
            WHERE n + d > 0 AND i + n + d <= len(w)"""),
        ("rated", """SELECT *, len(list_intersect(run, goal)) AS k, len(run) + len(goal) - k AS all_of FROM tried WHERE len(run) > 0 AND len(goal) > 0"""),
        ("best", """SELECT transcript_id, seg_idx, pos, arg_max([i, span], (k / all_of, -i, -r)) AS top, max(k / all_of) AS score
            FROM rated GROUP BY ALL"""),
        ("aligned", """SELECT transcript_id, seg_idx, pos, (CASE WHEN score >= 0.55::DOUBLE THEN top[1] END)::BIGINT AS first_word,
            (CASE WHEN score >= 0.55::DOUBLE THEN top[2] END)::BIGINT AS n_words FROM goals LEFT JOIN best USING (transcript_id, seg_idx, pos)"""),
    ]


def seeds(lex: lx.Lexicon, k: int | None) -> list[tuple[str, str]]:
    hit = " + ".join(["0.0::DOUBLE"] + [f"(CASE WHEN {n} THEN {lex.weights[n]}::DOUBLE ELSE 0.0::DOUBLE END)" for n in lx.FLAGS])
    names = ", ".join(f"CASE WHEN {n} THEN '{n}' END" for n in lx.FLAGS)
    out = [
        ("noted", f"SELECT *, {annotation('text', lex)} FROM sents"),
        ("weighed", f"""SELECT *, (({hit}) + (CASE WHEN NOT starts_awkwardly AND word_count >= 8 AND NOT looks_incomplete
            THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)) * (1.0::DOUBLE - 0.6::DOUBLE * filler_ratio) AS raw_strength FROM noted"""),
        ("strong", f"""SELECT * EXCLUDE (raw_strength), round_even(raw_strength * 1000, 0) / 1000 AS strength,
            coalesce(nullif(concat_ws(', ', {names}), ''), 'strong statement') AS reason
            FROM weighed WHERE word_count >= 4 AND raw_strength >= 1.6"""),
        ("ranked_seeds", """SELECT *, (row_number() OVER (PARTITION BY transcript_id ORDER BY strength DESC, idx))::INT AS seed_rank FROM strong"""),
        ("seeds", "SELECT * FROM ranked_seeds" + (f" WHERE seed_rank <= {k}" if k else "")),
    ]
    return out


# ----------------------------------------------------------- windows, scores

def windows(targets=lx.TARGETS_MS, min_ms: int = 12_000, max_ms: int = 95_000) -> list[tuple[str, str]]:
    goals = ", ".join(f"({i}, {t})" for i, t in enumerate(targets))
    return [
        ("goals", f"SELECT * FROM (VALUES {goals}) g(target_ord, target_ms)"),
        ("edges", "SELECT transcript_id, block, min(idx) AS b_lo, max(idx) AS b_hi FROM sents GROUP BY ALL"),
        ("anchors", """SELECT s.transcript_id, s.seed_rank, s.idx AS a, e.b_lo, e.b_hi,
            CASE WHEN s.idx > e.b_lo AND s.gap_before_ms < 900 THEN s.idx - 1 ELSE s.idx END AS lo0
            FROM seeds s JOIN edges e USING (transcript_id, block)"""),
        ("steps", "SELECT *, unnest(range(0, 2 * least(200, greatest(lo0 - b_lo, b_hi - a)) + 1)) AS k FROM anchors"),
        ("places", """SELECT transcript_id, seed_rank, a, k,
            greatest(b_lo, lo0 - (CASE WHEN k % 2 = 1 THEN (k + 1) // 2 - 1 ELSE (k + 1) // 2 END)) AS lo,
            least(b_hi, a + (k + 1) // 2) AS hi FROM steps"""),
        ("path", """SELECT p.*, h.end_ms - l.start_ms AS ms FROM places p
            JOIN sents l ON l.transcript_id = p.transcript_id AND l.idx = p.lo
            JOIN sents h ON h.transcript_id = p.transcript_id AND h.idx = p.hi"""),
        ("picked", """SELECT transcript_id, seed_rank, a, target_ord, target_ms,
            coalesce(min(k) FILTER (WHERE ms >= target_ms), max(k)) AS k FROM path, goals GROUP BY ALL"""),
        ("shrunk", f"""SELECT g.*, p.lo, CASE WHEN p.ms > {max_ms} AND p.hi > p.a THEN p.hi - 1 ELSE p.hi END AS hi
            FROM picked g JOIN path p USING (transcript_id, seed_rank, a, k)"""),
        ("sized", f"""SELECT g.* FROM shrunk g
            JOIN sents l ON l.transcript_id = g.transcript_id AND l.idx = g.lo
            JOIN sents h ON h.transcript_id = g.transcript_id AND h.idx = g.hi
            WHERE h.end_ms - l.start_ms BETWEEN {min_ms} AND {max_ms}"""),
        ("trimmed", """SELECT g.transcript_id, g.seed_rank, g.a, g.target_ord, g.target_ms,
            min(x.idx) FILTER (WHERE x.idx <= g.a AND (x.idx = g.a OR NOT x.starts_awkwardly)) AS lo,
            max(x.idx) FILTER (WHERE x.idx >= g.a AND (x.idx = g.a OR NOT x.looks_incomplete)) AS hi
            FROM sized g JOIN noted x ON x.transcript_id = g.transcript_id AND x.idx BETWEEN g.lo AND g.hi GROUP BY ALL"""),
        ("windows", f"""SELECT g.transcript_id, g.seed_rank, g.a AS anchor, g.target_ord, g.target_ms, g.lo, g.hi, l.start_ms, h.end_ms
            FROM trimmed g JOIN sents l ON l.transcript_id = g.transcript_id AND l.idx = g.lo
            JOIN sents h ON h.transcript_id = g.transcript_id AND h.idx = g.hi WHERE h.end_ms - l.start_ms >= {min_ms}"""),
        ("distinct_windows", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
            PARTITION BY transcript_id, lo, hi ORDER BY seed_rank, target_ord) AS rn FROM windows) WHERE rn = 1"""),
    ]


def fallback(min_ms: int = 12_000) -> list[tuple[str, str]]:
    return [
        ("left_over", "SELECT * FROM sents WHERE transcript_id NOT IN (SELECT transcript_id FROM distinct_windows)"),
        ("walk", """SELECT transcript_id, idx, idx AS lo, start_ms AS lo_start, start_ms, end_ms FROM left_over WHERE idx = 0
            UNION ALL SELECT n.transcript_id, n.idx,
                CASE WHEN w.end_ms - w.lo_start >= 35000 THEN n.idx ELSE w.lo END,
                CASE WHEN w.end_ms - w.lo_start >= 35000 THEN n.start_ms ELSE w.lo_start END, n.start_ms, n.end_ms
            FROM walk w JOIN left_over n ON n.transcript_id = w.transcript_id AND n.idx = w.idx + 1"""),
        ("even", f"""SELECT transcript_id, lo, max(idx) AS hi, min(start_ms) FILTER (WHERE idx = lo) AS start_ms,
            arg_max(end_ms, idx) AS end_ms FROM walk GROUP BY transcript_id, lo
            HAVING arg_max(end_ms, idx) - min(start_ms) FILTER (WHERE idx = lo) >= {min_ms}"""),
    ]


CANDIDATES = [
    ("merged", """SELECT transcript_id, lo, hi, start_ms, end_ms, seed_rank::BIGINT AS seed_rank, target_ord, anchor FROM distinct_windows
        UNION ALL SELECT transcript_id, lo, hi, start_ms, end_ms, lo + 1, 0, NULL FROM even"""),
    ("texts", """SELECT b.transcript_id, b.lo, b.hi, string_agg(s.text, ' ' ORDER BY s.idx) AS text FROM merged b
        JOIN sents s ON s.transcript_id = b.transcript_id AND s.idx BETWEEN b.lo AND b.hi GROUP BY ALL"""),
    ("cands", f"""SELECT b.*, t.text, coalesce(s.reason, 'even split') AS seed_reason,
        {', '.join(f'coalesce(s.{n}, false) AS {n}' for n in lx.FLAGS)}
        FROM merged b JOIN texts t USING (transcript_id, lo, hi)
        LEFT JOIN seeds s ON s.transcript_id = b.transcript_id AND s.idx = b.anchor"""),
]


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, round_even({x}, 0)))::INT"


def points(base: float, *rules: tuple[str, float]) -> str:
    terms = [f"(CASE WHEN {c} THEN {float(p)}::DOUBLE ELSE 0.0::DOUBLE END)" for c, p in rules]
    return clamp(" + ".join([f"{float(base)}::DOUBLE", *terms]))


def scores(source: str, lex: lx.Lexicon, out: str = "scored") -> list[tuple[str, str]]:
    """Scores of a relation with text, start_ms and end_ms; audio confidence unknown."""
    lead = flags("lead", lex)
    low = strip("lower(text)")
    pronouns = "|".join(lx.BARE_PRONOUNS)
    openers = " OR ".join(f"starts_with({low}, {q(p)})" for p in lx.DANGLING_OPENERS)

    def phrases(options, each):
        return [(f"contains(lower(text), {q(p)})", each) for p in options]

    f = {n: f"f_{n}" for n in lx.FLAGS}
    parts = {
        "hook": points(
            45, ("NOT lead_awkward", 15), ("lead_awkward", -20), ("lead_question", 12), ("lead_strong_claim", 20),
            ("lead_number", 8), ("lead_emotion", 10), ("lead_contrast", 8), ("lead_words BETWEEN 4 AND 22", 8),
            ("lead_words > 34", -12)),
        "clarity": clamp(
            "78.0::DOUBLE - 45.0::DOUBLE * f_filler + (CASE WHEN pace < 1.4 THEN -18.0::DOUBLE WHEN pace > 3.6 THEN -8.0::DOUBLE "
            "ELSE 0.0::DOUBLE END) + (CASE WHEN f_incomplete THEN -15.0::DOUBLE ELSE 0.0::DOUBLE END)"),
        "self_contained": points(
            70, ("f_awkward", -18), (f"({openers})", -12),
            (f"regexp_matches({low}, '^({pronouns})(\\s|$)')", -14), ("f_incomplete", -16),
            (f"regexp_matches({strip('text')}, '[.!?]$')", 10), ("f_words BETWEEN 90 AND 240", 8)),
        "emotion": points(35, (f["emotion"], 30), (f["story"], 18), ("contains(text, '!')", 6)),
        "novelty": points(40, (f["strong_claim"], 25), (f["contrast"], 15), (f["number"], 10), *phrases(lx.NOVEL_PHRASES, 8)),
        "story": points(30, (f["story"], 35), *phrases(lx.STORY_PHRASES, 10)),
        "actionability": points(30, (f["actionable"], 40), (f["number"], 8)),
        "audio_quality": "85",
    }

    def weighted(*pairs):
        return clamp(" + ".join(f"{w}::DOUBLE * score_{n}" for n, w in pairs))

    engagement = weighted(("hook", .34), ("clarity", .22), ("novelty", .16), ("emotion", .14), ("self_contained", .14))
    overall = weighted(("engagement", .30), ("hook", .22), ("self_contained", .16), ("clarity", .12), ("novelty", .10),
                       ("emotion", .05), ("audio_quality", .05))
    return [
        (out + "_0", f"SELECT *, string_split({strip('text')}, '. ')[1] AS lead FROM {source}"),
        (out + "_1", f"""SELECT *, {', '.join(f'{sql} AS lead_{n}' for n, sql in lead.items())}, {awkward('lead')} AS lead_awkward,
            {words('lead')} AS lead_words, {', '.join(f'{sql} AS f_{n}' for n, sql in flags('text', lex).items())},
            {filler('text', lex)} AS f_filler, {awkward('text')} AS f_awkward, {incomplete('text')} AS f_incomplete, {words('text')} AS f_words,
            {words('text')} / greatest(1.0::DOUBLE, greatest(0, end_ms - start_ms) / 1000.0::DOUBLE) AS pace FROM {out}_0"""),
        (out + "_2", f"SELECT *, {', '.join(f'{sql} AS score_{n}' for n, sql in parts.items())} FROM {out}_1"),
        (out + "_3", f"SELECT *, {engagement} AS score_engagement FROM {out}_2"),
        (out, f"SELECT *, {overall} AS score_overall FROM {out}_3"),
    ]


def adjusted(source: str, out: str = "adjusted") -> tuple[str, str]:
    return (out, f"""SELECT * REPLACE (greatest(0, least(100, score_overall + CASE WHEN end_ms - start_ms < 14000 THEN -6
        WHEN end_ms - start_ms > 82000 THEN -5 WHEN end_ms - start_ms BETWEEN 20000 AND 62000 THEN 2 ELSE 0 END))::INT AS score_overall) FROM {source}""")


def chain(lex: lx.Lexicon) -> list[tuple[str, str]]:
    """Everything up to scored and length-adjusted candidates."""
    return [*SENTS, *seeds(lex, 40), *windows(), *fallback(), *CANDIDATES, *scores("cands", lex), adjusted("scored")]


# ----------------------------------------------------------------- selection

LEVELS = ((0.45, 0.6), (0.55, 0.7), (0.65, 0.78), (0.75, 0.85))


def dedup(levels, source: str = "adjusted", n: int | None = None) -> list[tuple[str, str]]:
    """Greedy walk per transcript at each level; with ``n``, the relaxed choice."""
    out = [
        ("placed", f"""SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY score_overall DESC, seed_rank, target_ord) AS r,
            list_distinct({tokens('text')}) AS toks FROM {source}"""),
        ("pairs", """SELECT a.transcript_id, b.r, a.r AS foe,
            greatest(0, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms)) / greatest(0.001, least(a.end_ms - a.start_ms, b.end_ms - b.start_ms)) AS shared,
            CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0 ELSE
                len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) END AS alike
            FROM placed a JOIN placed b ON a.transcript_id = b.transcript_id AND a.r < b.r"""),
        ("sizes", "SELECT transcript_id, max(r) AS total FROM placed GROUP BY ALL"),
    ]
    for i, (overlap, text) in enumerate(levels):
        out += [
            (f"foes{i}", f"SELECT transcript_id, r, list(foe) AS foes FROM pairs WHERE shared > {overlap} OR alike > {text} GROUP BY ALL"),
            (f"walk{i}", f"""SELECT transcript_id, 0::BIGINT AS r, []::BIGINT[] AS kept FROM sizes
                UNION ALL SELECT w.transcript_id, w.r + 1, CASE WHEN f.foes IS NOT NULL AND list_has_any(w.kept, f.foes) THEN w.kept
                    ELSE list_append(w.kept, w.r + 1) END
                FROM walk{i} w JOIN sizes z ON z.transcript_id = w.transcript_id AND w.r < z.total
                LEFT JOIN foes{i} f ON f.transcript_id = w.transcript_id AND f.r = w.r + 1"""),
            (f"kept{i}", f"SELECT w.transcript_id, w.kept FROM walk{i} w JOIN sizes z ON z.transcript_id = w.transcript_id AND z.total = w.r"),
        ]
    if n is None:
        final = "SELECT transcript_id, kept FROM kept0"
    else:
        pick = "k0.kept"
        for i in range(1, len(levels)):
            pick = f"(CASE WHEN len({pick}) < {n} AND len(k{i}.kept) > len({pick}) THEN k{i}.kept ELSE {pick} END)"
        joined = " ".join(f"JOIN kept{i} k{i} USING (transcript_id)" for i in range(1, len(levels)))
        final = f"SELECT transcript_id, {pick} AS kept FROM kept0 k0 {joined}"
    out += [
        ("chosen_sets", final),
        ("uniq", "SELECT p.* FROM placed p JOIN chosen_sets c ON c.transcript_id = p.transcript_id AND list_contains(c.kept, p.r)"),
    ]
    return out


def top_n(n: int, source: str = "uniq") -> tuple[str, str]:
    return ("best", f"""SELECT *, concat_ws('-', transcript_id, lo, hi) AS clip_id, (row_number() OVER (PARTITION BY transcript_id
        ORDER BY score_overall DESC, start_ms, seed_rank, target_ord))::INT AS index FROM {source}
        QUALIFY index <= {n}""")


# ---------------------------------------------------------------- boundaries

EVEN_WORDS = [
    ("word_parts", "SELECT transcript_id, idx, start_ms, end_ms, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS p FROM sents"),
    ("word_rows", f"SELECT *, len(p) AS np, {numbered('p', 'word', 'i')} FROM word_parts"),
    ("words", """SELECT transcript_id, idx, i, word, round_even(start_ms::DOUBLE + (end_ms - start_ms) / np * i, 0)::BIGINT AS w_start,
        round_even(start_ms::DOUBLE + (end_ms - start_ms) / np * i + (end_ms - start_ms) / np * 0.8::DOUBLE, 0)::BIGINT AS w_end FROM word_rows"""),
]
GAPS = [
    ("follow", "SELECT transcript_id, w_end AS a, lead(w_start) OVER (PARTITION BY transcript_id ORDER BY idx, i) AS b FROM words"),
    ("gaps", "SELECT transcript_id, (a + b) / 2 AS mid FROM follow WHERE b - a >= 60"),
]


def refined(source: str = "best") -> list[tuple[str, str]]:
    def near(side: str, t: str) -> tuple[str, str]:
        return (f"gap_{side}", f"""SELECT x.clip_id, round_even(arg_min(g.mid, (abs(g.mid - x.{t}), g.mid)), 0) AS g FROM ends x
            LEFT JOIN gaps g ON g.transcript_id = x.transcript_id AND abs(g.mid - x.{t}) <= 2500 GROUP BY ALL""")

    facts = f"s.idx, s.start_ms AS s_start, s.end_ms AS s_end, s.text, {awkward('s.text')} AS awk, {incomplete('s.text')} AS inc"
    return [
        ("inside", f"""SELECT c.clip_id, c.transcript_id, {facts} FROM {source} c JOIN sents s ON s.transcript_id = c.transcript_id
            AND s.end_ms > c.start_ms + 150 AND s.start_ms < c.end_ms - 150"""),
        ("nearest_one", f"""SELECT c.clip_id, c.transcript_id, {facts}
            FROM {source} c JOIN sents s ON s.transcript_id = c.transcript_id WHERE c.clip_id NOT IN (SELECT clip_id FROM inside)
            QUALIFY row_number() OVER (PARTITION BY c.clip_id ORDER BY abs(s.start_ms - c.start_ms), s.idx) = 1"""),
        ("covered", "SELECT * FROM inside UNION ALL SELECT * FROM nearest_one"),
        ("headed", "SELECT clip_id, coalesce(min(idx) FILTER (WHERE NOT awk), max(idx)) AS f, max(idx) FILTER (WHERE NOT inc) AS l FROM covered GROUP BY ALL"),
        ("within", "SELECT c.* FROM covered c JOIN headed h USING (clip_id) WHERE idx >= f AND idx <= greatest(f, coalesce(l, f))"),
        ("ends", "SELECT clip_id, transcript_id, arg_min(s_start, idx) AS t0, arg_max(s_end, idx) AS t1 FROM within GROUP BY ALL"),
        near("lo", "t0"), near("hi", "t1"),
        ("cut", """SELECT e.clip_id, e.transcript_id, CASE WHEN abs(a.g - t0) < 1200 THEN a.g::BIGINT ELSE t0 END AS c0,
            CASE WHEN abs(b.g - t1) < 1200 THEN b.g::BIGINT ELSE t1 END AS c1
            FROM ends e JOIN gap_lo a USING (clip_id) JOIN gap_hi b USING (clip_id)"""),
        ("lengths", "SELECT transcript_id, max(end_ms) AS duration FROM sents GROUP BY ALL"),
        ("padded", "SELECT clip_id, transcript_id, duration, greatest(0, c0 - 350) AS r0, least(duration, c1 + 350) AS r1 FROM cut JOIN lengths USING (transcript_id)"),
        ("final_spans", "SELECT clip_id, transcript_id, r0 AS start_ms, CASE WHEN r1 - r0 < 12000 THEN least(duration, r0 + 12000) ELSE r1 END AS end_ms FROM padded"),
        ("clip_rows", f"""SELECT w.clip_id, row_number() OVER (PARTITION BY w.clip_id ORDER BY w.idx) - 1 AS n, w.idx, greatest(f.start_ms, w.s_start) AS seg_start,
            least(f.end_ms, w.s_end) AS seg_end, f.start_ms, f.end_ms, w.transcript_id,
            CASE WHEN row_number() OVER (PARTITION BY w.clip_id ORDER BY w.idx) = 1 THEN {strip_filler('w.text')} ELSE w.text END AS text
            FROM within w JOIN final_spans f USING (clip_id)"""),
        ("clip_texts", f"SELECT clip_id, {strip('x')} AS text FROM (SELECT clip_id, string_agg(text, ' ' ORDER BY n) AS x FROM clip_rows GROUP BY ALL)"),
    ]


def shorten(x: str, limit: int) -> str:
    return f"(CASE WHEN length({x}) <= {limit} THEN {x} ELSE regexp_replace(substr({x}, 1, {limit - 3}), ' [^ ]*$', '') || '…' END)"


def slug(x: str, limit: int = 40) -> str:
    s = f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '-')"
    cut = f"(CASE WHEN length({s}) > {limit} THEN regexp_replace(substr({s}, 1, {limit}), '-[^-]*$', '') ELSE {s} END)"
    return f"coalesce(nullif({cut}, ''), 'clip')"


def file_name(index: str, category: str, hook: str, top: str) -> str:
    known = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in lx.CATEGORY_SLUGS.items())
    other = slug(f"coalesce(nullif({category}, ''), 'clip')", 16)
    cat = f"(CASE lower(coalesce({category}, '')) {known} ELSE {other} END)"
    tail = slug(hook, 32)
    return f"""(printf('%02d', {index}) || '_' || (CASE WHEN {top} THEN 'highest-potential'
        WHEN {tail} <> 'clip' THEN {cat} || '_' || {tail} ELSE {cat} END) || '.mp4')"""


def hook_parts(text: str) -> tuple[str, str]:
    """First and second sentence of a text, cleaned as hooks."""
    arr = sentences(text)
    first = f"rtrim(coalesce({strip_filler(f'({arr})[1]')}, {strip(text)}), '.')"
    second = f"rtrim({strip_filler(f'({arr})[2]')}, '.')"
    return first, second


# ------------------------------------------------------------ cues, tracks

CLIP_WORDS = [
    ("clip_words", """SELECT r.clip_id, row_number() OVER (PARTITION BY r.clip_id ORDER BY r.n, w.i) AS r, w.word,
        w.w_start - r.start_ms AS s, w.w_end - r.start_ms AS e
        FROM clip_rows r JOIN words w ON w.transcript_id = r.transcript_id AND w.idx = r.idx AND w.w_end > r.start_ms AND w.w_start < r.end_ms"""),
]


def cues(max_words: int) -> list[tuple[str, str]]:
    new = f"c.n >= {max_words} OR w.s - c.e > 700 OR w.e - c.first > 2800 OR regexp_matches(c.word, '[.!?]$')"
    return [
        ("pack", f"""SELECT clip_id, r, word, s, e, s AS first, 1 AS n, 0 AS cue_idx FROM clip_words WHERE r = 1
            UNION ALL SELECT w.clip_id, w.r, w.word, w.s, w.e, CASE WHEN {new} THEN w.s ELSE c.first END,
                CASE WHEN {new} THEN 1 ELSE c.n + 1 END, CASE WHEN {new} THEN c.cue_idx + 1 ELSE c.cue_idx END
            FROM pack c JOIN clip_words w ON w.clip_id = c.clip_id AND w.r = c.r + 1"""),
        ("plain_cues", """SELECT clip_id, cue_idx, greatest(0, min(first)) AS s, greatest(greatest(0, min(first)) + 200, arg_max(e, r)) AS e,
            string_agg(word, ' ' ORDER BY r) AS words, count(*) AS n FROM pack GROUP BY clip_id, cue_idx"""),
        ("next_cues", "SELECT *, coalesce(lead(s) OVER (PARTITION BY clip_id ORDER BY cue_idx), e + 400) AS follow FROM plain_cues"),
        ("cues", """SELECT clip_id, cue_idx, s AS start_ms, CASE WHEN least(follow - 20, e + 350) <= s THEN s + 250
            ELSE least(follow - 20, e + 350) END AS end_ms, words, n FROM next_cues"""),
    ]


def events(highlight: tuple[str, ...]) -> list[tuple[str, str]]:
    wanted = ", ".join(q(w) for w in highlight)
    return [
        ("cue_words", """SELECT p.clip_id, p.cue_idx, row_number() OVER (PARTITION BY p.clip_id, p.cue_idx ORDER BY p.r) - 1 AS word_idx,
            p.word, p.s, p.e, c.start_ms AS cs, c.end_ms AS ce, c.n FROM pack p JOIN cues c USING (clip_id, cue_idx)"""),
        ("word_events", f"""SELECT clip_id, cue_idx, word_idx, greatest(cs, s) AS start_ms,
            least(ce, greatest(greatest(cs, s) + 80, CASE WHEN word_idx = n - 1 THEN ce ELSE e END)) AS end_ms, word AS text,
            lower(regexp_replace(word, '[^\\p{{L}}\\p{{N}}_'']+', '', 'g')) IN ({wanted}) AS is_emphasis FROM cue_words"""),
    ]


def tracks(step_ms: int, tile_ms: int) -> list[tuple[str, str]]:
    """Events as observations of a user; every tile of a user's time is a clip."""
    return [
        ("obs", """SELECT user_id AS track_id, (epoch_us(ts) // 1000)::BIGINT AS t_ms, value / 500.0::DOUBLE AS cx, event_id FROM events"""),
        ("one_obs", "SELECT track_id, t_ms, min(cx) AS cx FROM obs GROUP BY ALL"),
        ("clips", f"""SELECT DISTINCT track_id, t_ms // {tile_ms} AS tile, track_id || '-' || (t_ms // {tile_ms}) AS clip_id,
            (t_ms // {tile_ms}) * {tile_ms} AS start_ms, (t_ms // {tile_ms} + 1) * {tile_ms} AS end_ms FROM obs"""),
        ("inside_obs", "SELECT c.clip_id, o.t_ms, o.cx FROM clips c JOIN one_obs o ON o.track_id = c.track_id AND o.t_ms BETWEEN c.start_ms AND c.end_ms"),
        ("grid", f"SELECT clip_id, unnest(range(0, {tile_ms // step_ms + 1})) AS i, start_ms FROM clips"),
        ("points", f"SELECT clip_id, i, start_ms + i * {step_ms} AS t_ms FROM grid"),
        ("back", "SELECT p.clip_id, p.i, p.t_ms, o.t_ms AS a_t, o.cx AS a_v FROM points p ASOF LEFT JOIN inside_obs o ON o.clip_id = p.clip_id AND o.t_ms <= p.t_ms"),
        ("sides", "SELECT p.*, o.t_ms AS b_t, o.cx AS b_v FROM back p ASOF LEFT JOIN inside_obs o ON o.clip_id = p.clip_id AND o.t_ms >= p.t_ms"),
        ("resampled", """SELECT clip_id, i, t_ms, CASE WHEN a_t IS NULL THEN b_v WHEN b_t IS NULL THEN a_v
            ELSE a_v + (t_ms - a_t) / greatest(0.001::DOUBLE, b_t - a_t) * (b_v - a_v) END AS value FROM sides"""),
    ]


SMOOTH = [
    ("fwd", """SELECT clip_id, i, value AS y FROM resampled WHERE i = 0
        UNION ALL SELECT r.clip_id, r.i, 0.16::DOUBLE * r.value + 0.84::DOUBLE * f.y FROM fwd f JOIN resampled r ON r.clip_id = f.clip_id AND r.i = f.i + 1"""),
    ("last_i", "SELECT clip_id, max(i) AS m FROM fwd GROUP BY ALL"),
    ("bwd", """SELECT f.clip_id, f.i, f.y FROM fwd f JOIN last_i l ON l.clip_id = f.clip_id AND l.m = f.i
        UNION ALL SELECT f.clip_id, f.i, 0.6::DOUBLE * f.y + 0.4::DOUBLE * b.y FROM bwd b JOIN fwd f ON f.clip_id = b.clip_id AND f.i = b.i - 1"""),
]


def slewed(source: str, limit: str) -> list[tuple[str, str]]:
    return [
        ("slew", f"""SELECT clip_id, i, y FROM {source} WHERE i = 0
            UNION ALL SELECT s.clip_id, s.i, p.y + greatest(-{limit}, least({limit}, s.y - p.y))
            FROM slew p JOIN {source} s ON s.clip_id = p.clip_id AND s.i = p.i + 1"""),
    ]
