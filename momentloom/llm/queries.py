"""One registered query per operator, over its whole table, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentloom.llm.collocations import collocations
from momentloom.llm.convtrie import conversation_trie
from momentloom.llm.decontam import contaminated
from momentloom.llm.exactdedup import exact_duplicates
from momentloom.llm.htmltext import extract
from momentloom.llm.langid import identify
from momentloom.llm.linededup import deduplicate_lines
from momentloom.llm.maxscore import top_k
from momentloom.llm.minhash import near_duplicates
from momentloom.llm.mixing import mix
from momentloom.llm.pii import sanitise
from momentloom.llm.shared import table
from momentloom.llm.toxicity import toxicity
from momentloom.llm.warc import archive

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def _shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"), _shared_turns)


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_decontamination": op2_decontamination,
    "op3_language": op3_language,
    "op4_html": op4_html,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_pii": op6_pii,
    "op7_minhash": op7_minhash,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_collocations": op11_collocations,
    "op12_top_k": op12_top_k,
    "op13_conversation_trie": op13_conversation_trie,
}

_WHITE = r"[\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op1_mixing": rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM s),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][k % 3 + 1] AS weight, [0.5::DOUBLE, -0.5, 0.0][k % 3 + 1] AS tilt, 2.0::DOUBLE * source_size AS lim FROM r),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY lim / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM w),
f AS (SELECT min_by(level, (lim / weight, k)) AS final FROM l WHERE level * weight < lim),
t AS (SELECT source, source_size, tilt, CASE WHEN final IS NULL THEN lim ELSE least(lim, final * weight) END AS target FROM l, f),
p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.tilt, round(t.target)::BIGINT AS words,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS whole FROM p),
u AS (SELECT *, least(greatest(words - whole * source_size - start, 0), size) AS part FROM q),
v AS (SELECT *, whole * size + part AS taken, start::DOUBLE / nullif(target, 0) AS demand FROM u)
SELECT doc_id, source, size, source_size, target, taken::BIGINT AS taken,
  (CASE WHEN size > 0 THEN whole + CASE WHEN part > 0 THEN 1 ELSE 0 END ELSE 0 END)::BIGINT AS passes,
  CASE WHEN taken > 0 THEN floor(CASE WHEN tilt = 0 THEN demand ELSE (sqrt((1.0::DOUBLE - tilt) * (1.0::DOUBLE - tilt) + 4.0::DOUBLE * tilt * demand) - (1.0::DOUBLE - tilt)) / (2.0::DOUBLE * tilt) END * 1000000)::BIGINT END AS position
FROM v""",
    "op5_exact_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_WHITE}', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, keep_id, group_size, d.doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
    "op7_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: hash(array_to_string(words[i:i + 4], ' ')))
  WHEN len(words) > 0 THEN [hash('short ' || array_to_string(words, ' '))] ELSE [] END) AS shingles FROM w),
e AS (SELECT doc_id, unnest(shingles) AS x FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 75 * (len(sa.shingles) + len(sb.shingles) - n)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a AS node, a AS root FROM sym UNION SELECT sym.b, reach.root FROM reach JOIN sym ON sym.a = reach.node),
c AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM s LEFT JOIN c ON c.node = doc_id""",
    "op9_line_dedup": r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, r.first_doc IS NOT NULL AND r.first_doc <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op11_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i : i + size - 1], ' '))) AS phrase FROM w, range(1, 4) s(size)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
x AS (SELECT k.*, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.size = k AND l.phrase = array_to_string(ws[1:k], ' ')
  JOIN f r ON r.lang = k.lang AND r.size = k.size - k AND r.phrase = array_to_string(ws[k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS most FROM (SELECT lang, a, array_to_string(ws[1:2], ' ') AS phrase FROM c WHERE size = 3
  UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM c WHERE size = 3) GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase AND b.size = 2 WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) QUALIFY rank <= 2000""",
    "op12_top_k": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64.0::DOUBLE * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST)::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20""",
    "op13_conversation_trie": r"""
WITH o AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, turn, sha256(length(role) || ':' || role || text) AS dig, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM o),
t AS (SELECT conv_id, dig, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dig) AS pos FROM g),
s AS (SELECT conv_id, max(pos) AS n FROM t GROUP BY conv_id),
f AS (SELECT conv_id, conv_id - conv_id % 20 AS base, n, xor(4294967295::BIGINT, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1))), 4294967295::BIGINT)) % 4 AS h FROM s),
c AS (SELECT f.*, least(f.h, coalesce(b.n, 0)) AS took FROM f LEFT JOIN s b ON b.conv_id = f.base),
r AS (SELECT c.conv_id, pos - h + took AS d, dig, words FROM t JOIN c USING (conv_id) WHERE pos > h
  UNION ALL SELECT c.conv_id, pos, dig, words FROM c JOIN t ON t.conv_id = c.base AND pos <= took),
q AS (SELECT c.conv_id, coalesce(list(dig ORDER BY d) FILTER (d IS NOT NULL), []) AS digs, coalesce(list(words ORDER BY d) FILTER (d IS NOT NULL), []) AS ws FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
e AS (SELECT *, unnest(range(len(digs) + 1)) AS depth FROM q),
m AS (SELECT conv_id, depth, len(digs) = depth AS ends, array_to_string(digs[1:depth], '') AS key, array_to_string(digs[1:depth - 1], '') AS pkey, coalesce(ws[depth], 0) AS w FROM e),
v AS (SELECT depth, key, any_value(pkey) AS pkey, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY depth, key),
k AS (SELECT depth - 1 AS depth, pkey AS key, count(*) AS n_children FROM v WHERE depth > 0 GROUP BY ALL),
x AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN k USING (depth, key)),
y AS (SELECT m.depth, m.key, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n - 1) * x.w)::BIGINT AS saved_tokens FROM x JOIN m ON m.conv_id = x.conv_id AND m.depth <= x.depth GROUP BY ALL)
SELECT x.conv_id, x.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, x.n AS n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM x JOIN y USING (depth, key) LEFT JOIN v u ON u.depth = x.depth - 1 AND u.key = x.pkey AND x.depth > 0""",
}
