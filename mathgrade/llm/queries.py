"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, collocations, html_text, language_id, mixing, near_dup, periodic_runs, quality_model, quality_rules,
               suffix_dedup, tool_calls, vector_graph, warc)
from .common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


SQL_NEAR_DUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN comp c USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@register("op1_minhash_near_dedup", SQL_NEAR_DUP)
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_dup.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))


SQL_LEDGER = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
b AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
         length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM t),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM b WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT b.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(ls) AS n_lines, n_upper, n_letters,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM b LEFT JOIN rep USING (doc_id)),
f AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
       + 4 * (100 * n_symbols > 30 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
       + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
       + 64 * (100 * n_upper > 50 * n_letters)::BIGINT + 128 * (100 * n_stutter > 30 * n_words)::BIGINT AS fail_bits
  FROM m)
"""


@register("op2_quality_rules", SQL_LEDGER + """
SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits & 255 = 0 AS kept, 'v2' AS policy FROM f
""")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of all documents under the current policy."""
    led = quality_rules.ledger(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules.apply_policy(led, quality_rules.POLICIES[quality_rules.CURRENT])


@register("quality_rule_ablation", SQL_LEDGER + """
, p(policy, mask, bits) AS (VALUES ('base', 3, [0, 1]), ('v1', 15, [0, 1, 2, 3]), ('v2', 255, [0, 1, 2, 3, 4, 5, 6, 7])),
r AS (SELECT policy, mask, unnest(bits) AS i FROM p)
SELECT policy, ['few_words', 'repeated_windows', 'symbols', 'repeated_lines', 'short_words', 'long_words', 'upper_case',
        'stutter'][i + 1] AS rule,
       sum((fail_bits & (1 << i) <> 0)::BIGINT) AS n_failed, sum((fail_bits & mask = 1 << i)::BIGINT) AS n_only_this, count(*) AS n_docs
FROM f, r GROUP BY policy, i
""")
def quality_rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy rejects, and rejects alone."""
    return quality_rules.ablation(quality_rules.ledger(load(spark, sf_dir, "documents").select("doc_id", "text")))


@register("op10_source_mix", r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
         (sum(source_size) OVER ())::BIGINT AS budget FROM s),
o AS (
  SELECT *, (3 * source_size) AS cap,
         budget - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
  FROM w WHERE source_size > 0),
c AS (SELECT *, cap * rest_weight <= weight * rest AS capped FROM o),
u AS (SELECT max(rest) AS rest, max(rest_weight) AS rest_weight FROM c WHERE NOT capped),
g AS (
  SELECT c.source, CASE WHEN capped THEN cap::DOUBLE ELSE (weight * u.rest)::DOUBLE / u.rest_weight::DOUBLE END AS target
  FROM c, u),
q AS (
  SELECT d.*, s.source_size, coalesce(g.target, 0) AS target,
         (sum(size) OVER (PARTITION BY d.source ORDER BY turn, size))::BIGINT AS queued
  FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source LEFT JOIN g ON g.source IS NOT DISTINCT FROM d.source),
e AS (
  SELECT doc_id, source, turn, size, (queued + k * source_size)::DOUBLE / target AS finish
  FROM q, (VALUES (0), (1), (2)) v(k) WHERE size > 0 AND target > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, turn, size) AS run FROM e),
t AS (
  SELECT doc_id, source, size, count(*) AS copies FROM r WHERE run <= (SELECT sum(size) FROM d) GROUP BY ALL)
SELECT q.doc_id, q.source, q.size, q.source_size, q.target, q.size * coalesce(t.copies, 0) AS taken
FROM q LEFT JOIN t ON t.doc_id IS NOT DISTINCT FROM q.doc_id AND t.source IS NOT DISTINCT FROM q.source AND t.size = q.size
""")
def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken from each document by the mix of all sources."""
    return mixing.mix(load(spark, sf_dir, "documents").select("doc_id", "source", "text")) \
        .select("doc_id", "source", "size", "source_size", "target", "taken")


@register("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding digests of all documents."""
    return byte_bpe.encode(load(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


@register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from the documents that aren't held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return language_id.predict(docs, language_id.train(docs))


@register("op9_quality_model")
def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels that aren't held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_model.score(docs, quality_model.train(docs, load(spark, sf_dir, "labels")))


@register("op3_warc", r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN latest <> page_id THEN latest END AS refers_to
FROM m
""")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records, read back and indexed."""
    return warc.archive(load(spark, sf_dir, "pages").select("page_id", "url", "html")) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("warc_capture_index")
def warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captures of all pages in global order of URL key and time."""
    return warc.archive(load(spark, sf_dir, "pages").select("page_id", "url", "html")) \
        .select("position", "url_key", "date", "page_id", "record_type")


@register("op7_html_main_text")
def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html_text.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))


@register("op6_vector_graph")
def op6_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return vector_graph.nearest(load(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL_TOOL_CALLS = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, role, text, coalesce(to_json(text)::VARCHAR, 'null') AS js,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n,
         ['search', 'lookup', 'note', 'search', 'lookup', 'note', 'translate'][(conv_id + turn) % 7 + 1] AS name FROM conversations),
calls AS (
  SELECT *, 'call_' || conv_id || '_' || turn AS call_id,
         CASE name WHEN 'search' THEN '{"exact":' || (conv_id % 2 = 0) || ',"limit":' || n || ',"query":' || js || '}'
                   WHEN 'lookup' THEN '{"offset":' || turn || ',"query":' || js || '}'
                   WHEN 'note' THEN '{"body":' || js || ',"pinned":' || (conv_id % 2 = 0) || '}'
                   ELSE '{"text":' || js || '}' END AS args,
         CASE WHEN (conv_id + turn) % 17 = 0 THEN turn + 2
              WHEN (conv_id + turn - 2) % 17 <> 0 AND turn % 8 >= 2 THEN turn - 2 END AS needs
  FROM c WHERE role = 'assistant'),
known AS (SELECT a.*, b.turn AS needs_turn FROM calls a LEFT JOIN calls b ON a.conv_id = b.conv_id AND a.needs = b.turn),
lev AS (
  SELECT conv_id, turn, 0 AS level FROM known WHERE needs_turn IS NULL
  UNION ALL SELECT k.conv_id, k.turn, l.level + 1 FROM known k JOIN lev l ON k.conv_id = l.conv_id AND k.needs_turn = l.turn),
level AS (
  SELECT k.conv_id, k.turn, coalesce(max(l.level), -1) AS level
  FROM known k LEFT JOIN lev l ON l.conv_id = k.conv_id AND l.turn = k.turn GROUP BY k.conv_id, k.turn),
results AS (
  SELECT u.*, k.turn AS call_turn, k.call_id FROM c u JOIN calls k ON u.conv_id = k.conv_id AND u.turn = k.turn + 1 WHERE u.role = 'user')
SELECT k.conv_id, k.turn, 'call' AS kind, k.call_id, k.name,
       CASE WHEN l.level < 0 THEN 'cycle' WHEN r.turn IS NULL THEN 'no_result' ELSE 'ok' END AS status, l.level, k.turn AS call_turn, 0 AS part,
       array_to_string(list_filter([
         CASE WHEN k.name = 'search' AND k.n < 1 THEN 'limit: minimum 1' END,
         CASE WHEN k.name = 'search' AND k.n > 100 THEN 'limit: maximum 100' END,
         CASE WHEN k.name = 'search' AND length(k.text) < 1 THEN 'query: minLength 1' END,
         CASE WHEN k.name = 'note' AND length(k.text) > 1000 THEN 'body: maxLength 1000' END,
         CASE WHEN k.name = 'translate' THEN 'translate: unknown tool' END,
         CASE WHEN k.needs IS NOT NULL AND k.needs_turn IS NULL THEN 'depends_on: unknown call_' || k.conv_id || '_' || k.needs END],
         lambda e: e IS NOT NULL), '; ') AS errors,
       '{"content":' || k.js || ',"role":"assistant","tool_calls":[{"arguments":' || k.args || ',"id":"' || k.call_id || '","name":"' || k.name || '"}]}' AS json
FROM known k JOIN level l USING (conv_id, turn) LEFT JOIN results r ON r.conv_id = k.conv_id AND r.call_turn = k.turn
UNION ALL
SELECT r.conv_id, r.turn, 'result', r.call_id, NULL, 'ok', l.level, r.call_turn, 1, '',
       '{"content":' || r.js || ',"role":"tool","tool_call_id":"' || r.call_id || '"}'
FROM results r JOIN level l ON l.conv_id = r.conv_id AND l.turn = r.call_turn
UNION ALL
SELECT c.conv_id, c.turn, 'message', NULL, NULL, 'plain', 0, c.turn, 0, '', '{"content":' || js || ',"role":"' || role || '"}'
FROM c WHERE role <> 'assistant' AND NOT EXISTS (SELECT 1 FROM results r WHERE r.conv_id = c.conv_id AND r.turn = c.turn)
"""


@register("op5_tool_call_chat", SQL_TOOL_CALLS)
def op5_tool_call_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked, ordered, validated and serialised messages of all conversations."""
    linked = tool_calls.link(tool_calls.calls_of(load(spark, sf_dir, "conversations")))
    return linked.withColumn("errors", F.array_join("errors", "; "))


@register("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words of all documents, a tenth of which are made periodic first."""
    docs = periodic_runs.planted(load(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.periodic_runs(docs)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = [F.col("best")[c].alias(c) for c in ("start", "length", "period")]
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli,
                        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


SQL_COLLOCATIONS = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
p AS (SELECT row_number() OVER () AS piece_id, lang, piece
      FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t)),
w AS (SELECT lang, piece_id, unnest(ws) AS w, unnest(range(len(ws))) AS i
      FROM (SELECT lang, piece_id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
x AS (SELECT lang, w, lead(w) OVER q AS w2, lead(w, 2) OVER q AS w3 FROM w WINDOW q AS (PARTITION BY piece_id ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, w AS phrase, count(*) AS f FROM x GROUP BY ALL
  UNION ALL SELECT lang, 2, w || ' ' || w2, count(*) FROM x WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3, count(*) FROM x WHERE w3 IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
  FROM c JOIN (VALUES (1), (2)) v(j) ON j < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
big AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, f FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), f FROM c WHERE k = 3) GROUP BY ALL),
kept AS (
  SELECT low.* FROM low LEFT JOIN big ON big.lang = low.lang AND big.phrase = low.phrase
  WHERE big.f IS NULL OR 100 * big.f < 50 * low.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
       score::BIGINT AS score
FROM kept JOIN n ON n.lang = kept.lang QUALIFY rank <= 2000
"""


@register("op12_collocations", SQL_COLLOCATIONS)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of two and three words of each language."""
    found = collocations.collocations(load(spark, sf_dir, "documents").select("lang", "text"))
    return found.withColumn("rank", F.col("rank").cast("long"))


SQL_SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(strlen(h) // 2 - 49, 0))) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING count(*) > 1),
hit AS (SELECT w.doc_id, w.i FROM w JOIN m ON m.s = w.s WHERE m.low < w.doc_id),
mark AS (SELECT *, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -99) > 50 AS opens FROM hit),
run AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM mark),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r),
gap AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM span),
cut AS (
  SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gap JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, strlen(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN cut.doc_id IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""


@register("op13_suffix_dedup", SQL_SUFFIX_DEDUP)
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 bytes or more that an earlier one holds."""
    found = suffix_dedup.remove_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
