"""Queries: projection/filter/sampling (P), joins and set operations (J),
aggregation/window/top-k (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import grading as G
from ..functions import text as TX
from ..operators import aggregate as AG
from ..operators import metrics as M
from ..operators import shape as SH
from . import driver_tables as dt
from . import evaluate as ev
from . import sql_views as S
from .registry import register, rounded

GRADED_Q = f"WITH {S.GRADED}"


def _graded(spark, sf_dir, *keep):
    """Graded samples; the number is extracted below the join and the text dropped unless it is kept."""
    raw = dt.raw_samples(spark, sf_dir).withColumn("pred", A.six_way("completion")).withColumn("n_chars", F.length("completion"))
    return raw.select("question_id", "sample_number", "pred", *keep).join(dt.references(spark, sf_dir), "question_id") \
        .withColumn("correct", G.relative("pred", "expected_answer"))


def _pq_sql():
    return f"""{GRADED_Q},
pq AS (SELECT question_id, level, count(*) AS attempts, CAST(sum(CAST(correct AS INTEGER)) AS BIGINT) AS correct_count,
       bool_or(correct) AS passed FROM graded GROUP BY question_id, level)"""


def _pq(spark, sf_dir):
    counts = ev.grade_counts(ev.answer_counts(dt.raw_samples(spark, sf_dir)), dt.references(spark, sf_dir))
    return M.pass_any(counts, carry=("level",), weight="cnt").select(
        "question_id", "level", "attempts", "correct_count", "passed")


# --------------------------------------------------------------------------
# P
# --------------------------------------------------------------------------

P01_SQL = f"""WITH {S.QUESTIONS}
SELECT question_id AS original_id, answer AS solution_text, level, CAST(NULL AS VARCHAR) AS model_name,
  CAST(0 AS INTEGER) AS source_idx
FROM questions"""


@register("p01_rename_select_ensure", P01_SQL)
def p01_rename_select_ensure(spark, sf_dir):
    """Rename, select, add a missing typed column, default a column."""
    q = dt.questions(spark, sf_dir)
    q = SH.rename_columns(q, {"question_id": "original_id", "answer": "solution_text"})
    q = SH.select_columns(q, ["original_id", "solution_text", "level"])
    q = SH.ensure_columns(q, {"model_name": "string", "level": "int"})
    return SH.default_column(q, "source_idx", F.lit(0).cast("int"))


P05_SQL = """SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS BIGINT) AS original_id,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS idx_in_customer
FROM orders"""


@register("p05_add_row_id", P05_SQL)
def p05_add_row_id(spark, sf_dir):
    """Global 0-based position and position within a group, computed
    with range partitioning and per-partition offsets (no single-task window)."""
    o = dt.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    g = SH.add_row_id(o, ["o_totalprice", "o_orderkey"], "original_id")
    g = AG.running_index(g, "o_custkey", ["o_orderdate", "o_orderkey"], "idx_in_customer")
    return g.select("o_orderkey", F.col("original_id").cast("bigint"), F.col("idx_in_customer").cast("bigint"))


P06_SQL = f"""{GRADED_Q}
SELECT question_id, sample_number, level FROM graded
WHERE level IN (1, 3) AND question_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""


@register("p06_filter_in", P06_SQL)
def p06_filter_in(spark, sf_dir):
    """Literal isin on level plus a left-semi join on a key table."""
    g = _graded(spark, sf_dir)
    keys = dt.table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey")
    g = SH.filter_in(SH.filter_in(g, "level", [1, 3]), "question_id", keys)
    return g.select("question_id", "sample_number", "level")


P07_SQL = f"""SELECT vec_id, round(exp(-list_avg({S.EMB_LOGP})), 6) AS perplexity FROM embeddings
WHERE exp(-list_avg({S.EMB_LOGP})) > 1.08"""


@register("p07_threshold_filter", P07_SQL)
def p07_threshold_filter(spark, sf_dir):
    """Rows whose perplexity exceeds a fixed threshold."""
    e = dt.table(spark, sf_dir, "embeddings").select(
        "vec_id", M.perplexity(F.transform("embedding", lambda x: -F.abs(x.cast("double")))).alias("perplexity"))
    return rounded(SH.threshold_filter(e, "perplexity", 1.08))


P08_SQL = """SELECT doc_id, n_chars FROM documents WHERE n_chars > (SELECT quantile_cont(n_chars, 0.95) FROM documents)"""


@register("p08_quantile_filter", P08_SQL)
def p08_quantile_filter(spark, sf_dir):
    """Rows above the interpolated 95 % quantile."""
    return SH.quantile_filter(dt.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", 0.95)


P09_SQL = f"""{_pq_sql()}
SELECT question_id, level, attempts, correct_count FROM pq WHERE NOT passed"""


@register("p09_failures", P09_SQL)
def p09_failures(spark, sf_dir):
    """Questions that did not pass."""
    return SH.failures(_pq(spark, sf_dir), ["question_id", "level", "attempts", "correct_count"])


P11_SQL = """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 10"""


@register("p11_head_slice", P11_SQL)
def p11_head_slice(spark, sf_dir):
    """An ordered slice [10, 110) (top-k per partition, then merged)."""
    o = dt.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return SH.head(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 100, offset=10)


P12_SQL = f"""WITH {S.RAW_SAMPLES}
SELECT question_id, arg_min(sample_number, struct_pack(s := sample_number, c := completion)) AS sample_number,
  arg_min(completion, struct_pack(s := sample_number, c := completion)) AS completion
FROM raw_samples GROUP BY question_id"""


@register("p12_first_per_group", P12_SQL)
def p12_first_per_group(spark, sf_dir):
    """First sample per question as a min_by aggregate (skew-safe)."""
    r = dt.raw_samples(spark, sf_dir)
    return SH.first_per_group(r, ["question_id"], F.struct("sample_number", "completion"))


P13_SQL = """SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 50"""


@register("p13_sample_n", P13_SQL)
def p13_sample_n(spark, sf_dir):
    """50 reproducible pseudo-random questions (seed 42)."""
    return SH.sample_n(dt.table(spark, sf_dir, "orders").select("o_orderkey"), 50, 42, "o_orderkey")


P14_SQL = """SELECT user_id, arg_min(event_id, struct_pack(h := md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))), e := event_id)) AS event_id,
  arg_min(event_type, struct_pack(h := md5(concat_ws('|', '42', CAST(event_id AS VARCHAR))), e := event_id)) AS event_type
FROM events GROUP BY user_id"""


@register("p14_random_one_per_group", P14_SQL)
def p14_random_one_per_group(spark, sf_dir):
    """One seeded pseudo-random event per user."""
    e = dt.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return SH.random_one_per_group(e, ["user_id"], 42, "event_id")


P16_SQL = f"""WITH m AS (SELECT vec_id, round(list_sum({S.EMB_LOGP}), 6) AS logp_sum,
  round(exp(-list_avg({S.EMB_LOGP})), 6) AS perplexity FROM embeddings)
UNPIVOT m ON logp_sum, perplexity INTO NAME metric VALUE value"""


@register("p16_melt", P16_SQL)
def p16_melt(spark, sf_dir):
    """Metrics in long form."""
    e = dt.table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: -F.abs(x.cast("double"))).alias("lp"))
    s = M.sequence_logp("lp")
    w = rounded(e.select("vec_id", s["logp_sum"].alias("logp_sum"), s["perplexity"].alias("perplexity")))
    return SH.melt(w, ["vec_id"], ["logp_sum", "perplexity"])


P17_SQL = """SELECT doc_id, CASE quality WHEN 0 THEN 'Incorrect' WHEN 1 THEN 'Correct' END AS label_name,
  coalesce(CASE toxic WHEN 1 THEN 'toxic' END, 'clean') AS toxic_name FROM labels"""


@register("p17_map_labels", P17_SQL)
def p17_map_labels(spark, sf_dir):
    """Literal label maps."""
    lab = dt.table(spark, sf_dir, "labels")
    return lab.select("doc_id", SH.map_labels("quality", {0: "Incorrect", 1: "Correct"}).alias("label_name"),
                      SH.map_labels("toxic", {1: "toxic"}, default="clean").alias("toxic_name"))


P19_SQL = f"""{GRADED_Q}
SELECT question_id, list(CASE WHEN round(pred, 6) = 0 THEN 0.0 ELSE round(pred, 6) END ORDER BY sample_number, completion) AS predictions,
  list(correct ORDER BY sample_number, completion) AS correct_predictions
FROM graded GROUP BY question_id"""


def _eval_rows(spark, sf_dir):
    pred = F.round("pred", 6)
    g = _graded(spark, sf_dir, "completion").withColumn("pred", F.when(pred == 0, F.lit(0.0)).otherwise(pred))  # one zero, without a sign
    return SH.collect_samples(g.withColumn("_o", F.struct("sample_number", "completion")), ["question_id"], "_o",
                              ["pred", "correct"]).withColumnsRenamed({"pred": "predictions", "correct": "correct_predictions"})


@register("p19_collect_samples", P19_SQL)
def p19_collect_samples(spark, sf_dir):
    """Per-question ordered lists of predictions and correctness."""
    return _eval_rows(spark, sf_dir)


P18_SQL = f"""{GRADED_Q}
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY sample_number, completion) - 1 AS INTEGER) AS sample_number,
  round(pred, 6) AS pred, correct FROM graded"""


@register("p18_explode_samples", P18_SQL)
def p18_explode_samples(spark, sf_dir):
    """Lists back to one row per (question, sample position)."""
    rows = _eval_rows(spark, sf_dir)
    return SH.explode_samples(rows, ["question_id"], {"pred": "predictions", "correct": "correct_predictions"})


P20_SQL = f"""WITH {S.QUESTIONS}
SELECT question_id, CAST(k AS INTEGER) AS sample_number FROM questions, range(3) t(k)"""


@register("p20_replicate_k", P20_SQL)
def p20_replicate_k(spark, sf_dir):
    """P20: k = 3 prompt rows per question."""
    return SH.replicate_k(dt.questions(spark, sf_dir).select("question_id"), 3)


P22_SQL = """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS level FROM orders"""


@register("p22_datasets_as_levels", P22_SQL)
def p22_datasets_as_levels(spark, sf_dir):
    """Three parts tagged with a level and unioned by name."""
    o = dt.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    parts = {1: o.filter("o_orderstatus = 'F'"), 2: o.filter("o_orderstatus = 'O'"),
             3: o.filter("o_orderstatus NOT IN ('F', 'O')")}
    return SH.as_levels({k: v.select("o_orderkey") for k, v in parts.items()}).withColumn("level", F.col("level").cast("int"))


P23_SQL = f"""{GRADED_Q}
SELECT question_id, sample_number, completion,
  CASE WHEN coalesce(correct, false) THEN completion ELSE 'reference: ' || CAST(expected_answer AS VARCHAR) END AS kept
FROM graded"""


@register("p23_keep_if_correct", P23_SQL)
def p23_keep_if_correct(spark, sf_dir):
    """The augmented text when judged correct, else the original."""
    g = _graded(spark, sf_dir, "completion")
    orig = F.concat(F.lit("reference: "), F.col("expected_answer").cast("string"))
    return g.select("question_id", "sample_number", "completion", SH.keep_if_correct("correct", "completion", orig).alias("kept"))


# --------------------------------------------------------------------------
# J
# --------------------------------------------------------------------------

J01_SQL = f"""{_pq_sql()}
SELECT q.question_id, q.level AS level_x, pq.level AS level_y, q.expected_answer, pq.attempts, pq.correct_count
FROM questions q JOIN pq USING (question_id)"""


@register("j01_join_suffixed", J01_SQL)
def j01_join_suffixed(spark, sf_dir):
    """Test set joined to results, shared names suffixed."""
    q = dt.questions(spark, sf_dir).select("question_id", "level", "expected_answer")
    r = _pq(spark, sf_dir).select("question_id", "level", "attempts", "correct_count")
    return SH.join_suffixed(q, r, "question_id")


J02_SQL = f"""{_pq_sql()}
SELECT q.question_id, q.level, pq.correct_count AS correct_count_pass_k
FROM questions q LEFT JOIN pq USING (question_id)"""


@register("j02_left_join", J02_SQL)
def j02_left_join(spark, sf_dir):
    """Left join keeps questions without samples."""
    q = dt.questions(spark, sf_dir).select("question_id", "level")
    r = _pq(spark, sf_dir).select("question_id", F.col("correct_count").alias("correct_count_pass_k"))
    return q.join(r, "question_id", "left")


J03_SQL = f"""{_pq_sql()},
a AS (SELECT level, count(*) AS n_all FROM pq GROUP BY level),
b AS (SELECT level, count(*) AS n_passed FROM pq WHERE passed GROUP BY level),
p AS (SELECT coalesce(a.level, b.level) AS level, CAST(coalesce(n_all, 0) AS INTEGER) AS n_all, CAST(coalesce(n_passed, 0) AS INTEGER) AS n_passed
FROM a FULL OUTER JOIN b USING (level)),
s AS (SELECT s_nationkey AS k, CAST(count(*) AS INTEGER) AS n_all FROM supplier WHERE s_acctbal < 0 GROUP BY 1),
c AS (SELECT c_nationkey AS k, CAST(count(*) AS INTEGER) AS n_passed FROM customer WHERE c_acctbal > 9000 GROUP BY 1)
SELECT 'level' AS part, CAST(level AS BIGINT) AS key, n_all, n_passed FROM p
UNION ALL
SELECT 'nation', CAST(coalesce(s.k, c.k) AS BIGINT), coalesce(n_all, 0), coalesce(n_passed, 0) FROM s FULL OUTER JOIN c ON s.k = c.k"""


@register("j03_outer_align", J03_SQL)
def j03_outer_align(spark, sf_dir):
    """Two grouped counts aligned on their key, missing -> 0: all and
    passed questions by level, and two counts by nation that lack different
    nations."""
    pq = _pq(spark, sf_dir)
    a = pq.groupBy("level").agg(F.count(F.lit(1)).alias("n_all"))
    b = pq.filter("passed").groupBy("level").agg(F.count(F.lit(1)).alias("n_passed"))
    s = dt.table(spark, sf_dir, "supplier").filter("s_acctbal < 0").groupBy(F.col("s_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n_all"))
    c = dt.table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("key")).agg(F.count(F.lit(1)).alias("n_passed"))
    parts = {"level": SH.outer_align(a, b, "level", "n_all", "n_passed").withColumnRenamed("level", "key"),
             "nation": SH.outer_align(s, c, "key", "n_all", "n_passed")}
    return SH.union_all([SH.tag(d.withColumn("key", F.col("key").cast("bigint")), part=p) for p, d in parts.items()]) \
        .select("part", "key", "n_all", "n_passed")


J06_SQL = """SELECT p_partkey AS id FROM part INTERSECT SELECT s_suppkey FROM supplier INTERSECT SELECT c_custkey FROM customer"""


@register("j06_intersect_ids", J06_SQL)
def j06_intersect_ids(spark, sf_dir):
    """Ids present in three tables."""
    p = dt.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    s = dt.table(spark, sf_dir, "supplier").select("s_suppkey")
    c = dt.table(spark, sf_dir, "customer").select("c_custkey")
    return SH.intersect_ids(p, s, c)


J07_SQL = """SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)"""


@register("j07_semi_lookup", J07_SQL)
def j07_semi_lookup(spark, sf_dir):
    """Rows whose key is in a filtered lookup table (left semi)."""
    li = dt.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    s = dt.table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("l_suppkey"))
    return SH.semi(li, s, "l_suppkey")


J08_SQL = f"""{_pq_sql()}
SELECT question_id, level FROM questions
WHERE CAST(question_id AS VARCHAR) NOT IN (SELECT CAST(question_id AS VARCHAR) FROM pq WHERE passed)"""


@register("j08_resume_anti_join", J08_SQL)
def j08_resume_anti_join(spark, sf_dir):
    """Questions still to do, ids compared as strings."""
    q = dt.questions(spark, sf_dir).select("question_id", "level")
    done = _pq(spark, sf_dir).filter("passed").select("question_id")
    return SH.anti(q, done, "question_id")


J09_SQL = f"""{GRADED_Q}
SELECT correct AS correctly_augmented, count(*) AS n FROM graded GROUP BY correct"""


@register("j09_verdict_split", J09_SQL)
def j09_verdict_split(spark, sf_dir):
    """Flag column and the two views; sizes per verdict."""
    flagged, _ok, _bad = SH.verdict_split(_graded(spark, sf_dir), F.col("correct"))
    return flagged.groupBy("correctly_augmented").agg(F.count(F.lit(1)).alias("n"))


def _variants(spark, sf_dir):
    """Symbolic variants: several line items per order, one table per
    difficulty (return flag), question text and '#### n' answer rendered."""
    li = dt.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    return li.select(F.col("l_orderkey").alias("original_id"), "l_linenumber", "l_partkey",
                     F.concat(F.lit("How many units of part "), F.col("l_partkey").cast("string"), F.lit("?")).alias("question"),
                     F.concat(F.lit("Count them.\n#### "), F.format_number(F.col("l_quantity") * 100, 0)).alias("answer"),
                     F.when(F.col("l_returnflag") == "A", "easy").when(F.col("l_returnflag") == "N", "medium")
                     .otherwise("hard").alias("difficulty"))


J10_SQL = """WITH v AS (
  SELECT l_orderkey AS original_id, l_linenumber, l_partkey,
    'How many units of part ' || CAST(l_partkey AS VARCHAR) || '?' AS question,
    'Count them.' || chr(10) || '#### ' || format('{:,}', CAST(round(l_quantity * 100) AS BIGINT)) AS answer,
    CASE l_returnflag WHEN 'A' THEN 'easy' WHEN 'N' THEN 'medium' ELSE 'hard' END AS difficulty
  FROM lineitem),
common AS (SELECT original_id FROM v WHERE difficulty = 'easy' INTERSECT SELECT original_id FROM v WHERE difficulty = 'medium'
           INTERSECT SELECT original_id FROM v WHERE difficulty = 'hard' INTERSECT SELECT o_orderkey FROM orders),
pick AS (SELECT original_id, difficulty,
    arg_min(question, struct_pack(h := md5(concat_ws('|', '42', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR))), n := l_linenumber, p := l_partkey, a := answer)) AS question,
    arg_min(answer, struct_pack(h := md5(concat_ws('|', '42', CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR))), n := l_linenumber, p := l_partkey, a := answer)) AS answer
  FROM v WHERE original_id IN (SELECT original_id FROM common) GROUP BY original_id, difficulty),
base AS (SELECT o_orderkey AS original_id, 'base' AS difficulty, 'Order ' || CAST(o_orderkey AS VARCHAR) || ' total?' AS question,
    'Add up.' || chr(10) || '#### ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS answer
  FROM orders WHERE o_orderkey IN (SELECT original_id FROM common))
SELECT original_id, difficulty, question, answer,
  nullif(replace(regexp_extract(answer, '####\\s*([0-9\\.,\\-]+)', 1), ',', ''), '') AS solution
FROM (SELECT * FROM pick UNION ALL SELECT * FROM base)"""


@register("j10_matched_evaluation_set", J10_SQL)
def j10_matched_evaluation_set(spark, sf_dir):
    """Ids common to all variant tables and the base set; one seeded
    variant per id and difficulty; '#### n' solution extracted (A9). One
    aggregate per id picks the variants of all difficulties, one join adds the
    base question."""
    v = _variants(spark, sf_dir)
    pick = F.struct(F.md5(F.concat_ws("|", F.lit("42"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))),
                    "l_linenumber", "l_partkey", "answer", "question")
    names = ("easy", "medium", "hard")
    per = v.groupBy("original_id").agg(*[F.min(F.when(F.col("difficulty") == d, pick)).alias(d) for d in names]).dropna(subset=list(names))
    o = dt.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("original_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" total?")).alias("question"),
        F.concat(F.lit("Add up.\n#### "), F.format_number(F.floor("o_totalprice"), 0)).alias("answer"))
    rows = F.array(F.struct(F.lit("base").alias("difficulty"), "question", "answer"),
                   *[F.struct(F.lit(d).alias("difficulty"), F.col(f"{d}.question").alias("question"), F.col(f"{d}.answer").alias("answer")) for d in names])
    out = per.join(o, "original_id").select("original_id", F.explode(rows).alias("r")).select("original_id", "r.*")
    return out.withColumn("solution", A.hash_text("answer"))


# --------------------------------------------------------------------------
# G
# --------------------------------------------------------------------------

G01_SQL = f"""{_pq_sql()}
SELECT level, round(avg(CAST(passed AS DOUBLE)), 6) AS rate, count(*) AS n, round(1 - avg(CAST(passed AS DOUBLE)), 6) AS error_rate,
  round(sqrt(avg(CAST(passed AS DOUBLE)) * (1 - avg(CAST(passed AS DOUBLE))) / count(*)), 6) AS se,
  round(avg(CAST(correct_count AS DOUBLE)), 6) AS mean_correct_count
FROM pq GROUP BY level"""


@register("g01_rate_by_level", G01_SQL)
def g01_rate_by_level(spark, sf_dir):
    """Mean, count and binomial standard error by level."""
    pq = _pq(spark, sf_dir)
    a = AG.rate_with_se(pq, ["level"], "passed")
    b = AG.mean_by(pq, ["level"], ["correct_count"])
    return rounded(a.join(b, "level"))


G03_SQL = """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS round FROM events)
SELECT CAST(round AS BIGINT) AS round, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, count(*) AS count
FROM r GROUP BY round"""


@register("g03_pass_rate_by_round", G03_SQL)
def g03_pass_rate_by_round(spark, sf_dir):
    """Running index per source, then pass rate and size per round."""
    e = dt.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    r = AG.running_index(e, "user_id", ["ts", "event_id"], "round")
    r = r.withColumn("passed", F.col("event_type") == "purchase").withColumn("round", F.col("round").cast("bigint"))
    return rounded(AG.pass_rate_by(r, "round"))


G04_SQL = f"""{_pq_sql()}
SELECT level, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS P
FROM questions JOIN orders ON o_orderkey = question_id GROUP BY level"""


@register("g04_counts_side_by_side", G04_SQL)
def g04_counts_side_by_side(spark, sf_dir):
    """Group sizes by level for several statuses side by side (pivot)."""
    q = dt.questions(spark, sf_dir).join(dt.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("question_id"), "o_orderstatus"), "question_id")
    return AG.counts_side_by_side(q, "level", "o_orderstatus", ["F", "O", "P"])


G05_SQL = f"""{GRADED_Q},
rows AS (SELECT question_id, level, list(correct) AS flags FROM graded GROUP BY question_id, level)
SELECT level, round(1 - avg(coalesce(len(list_filter(flags, lambda x: x)) / len(flags), 0.0)), 6) AS incorrect_rate
FROM rows GROUP BY level"""


@register("g05_incorrect_rate", G05_SQL)
def g05_incorrect_rate(spark, sf_dir):
    """1 - mean share of correct flags per row, by level."""
    pq = _pq(spark, sf_dir)
    return rounded(AG.incorrect_rate(pq, ["level"], n="attempts", c="correct_count"))


G06_SQL = """SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY event_type"""


@register("g06_value_counts", G06_SQL)
def g06_value_counts(spark, sf_dir):
    """Value counts, largest first."""
    return AG.value_counts(dt.table(spark, sf_dir, "events"), "event_type")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
_N_TYPES = ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in EVENT_TYPES)
_SHARES = ", ".join(f"round({t} / ({' + '.join(EVENT_TYPES)}), 6) AS share_{t}" for t in EVENT_TYPES)
G07_SQL = f"""WITH c AS (SELECT CAST(date_part('day', ts) AS INTEGER) AS day, {_N_TYPES} FROM events GROUP BY 1)
SELECT day, {', '.join(EVENT_TYPES)}, {_SHARES} FROM c"""


@register("g07_crosstab_shares", G07_SQL)
def g07_crosstab_shares(spark, sf_dir):
    """Round x reason counts and row shares (day x event type here)."""
    e = dt.table(spark, sf_dir, "events").withColumn("day", F.dayofmonth("ts"))
    return rounded(AG.crosstab_shares(e, "day", "event_type", EVENT_TYPES))


G10_SQL = """SELECT o_orderstatus AS dataset, count(*) AS rows, count(DISTINCT o_orderpriority) AS levels,
  format('{:.2f}', avg(CAST(o_totalprice > 150000 AS INTEGER))) AS mean_pass,
  coalesce(format('{:.3f}', avg(CASE WHEN o_orderstatus <> 'P' THEN (o_orderkey % 8) / 8 END)), 'N/A') AS mean_novelty
FROM orders GROUP BY o_orderstatus"""


@register("g10_dataset_summary", G10_SQL)
def g10_dataset_summary(spark, sf_dir):
    """Rows, distinct levels, formatted mean pass, mean novelty or 'N/A'."""
    o = dt.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("level"),
        (F.col("o_totalprice") > 150000).cast("int").alias("pass_at_k"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 8 / 8).alias("novelty"))
    return AG.dataset_summary(o)


G11_SQL = """SELECT quality, count(n_chars) AS count, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std,
  min(n_chars) AS min, max(n_chars) AS max FROM documents JOIN labels USING (doc_id) GROUP BY quality"""


@register("g11_group_summary", G11_SQL)
def g11_group_summary(spark, sf_dir):
    """Count, mean, sample std, min, max by correctness label."""
    return rounded(AG.group_summary(dt.doc_features(spark, sf_dir), "quality", "n_chars"))


G12_SQL = """SELECT 'c_acctbal' AS column, count(c_acctbal) AS count, CAST(count(*) - count(c_acctbal) AS BIGINT) AS nulls,
  round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS std, min(c_acctbal) AS min,
  round(quantile_cont(c_acctbal, 0.25), 6) AS p25, round(quantile_cont(c_acctbal, 0.5), 6) AS p50,
  round(quantile_cont(c_acctbal, 0.75), 6) AS p75, max(c_acctbal) AS max FROM customer
UNION ALL
SELECT 'c_nationkey', count(c_nationkey), CAST(count(*) - count(c_nationkey) AS BIGINT), round(avg(c_nationkey), 6),
  round(stddev_samp(c_nationkey), 6), min(c_nationkey), round(quantile_cont(c_nationkey, 0.25), 6),
  round(quantile_cont(c_nationkey, 0.5), 6), round(quantile_cont(c_nationkey, 0.75), 6), max(c_nationkey) FROM customer"""


@register("g12_describe", G12_SQL)
def g12_describe(spark, sf_dir):
    """Describe numeric columns in one aggregate."""
    out = AG.describe(dt.table(spark, sf_dir, "customer"), ["c_acctbal", "c_nationkey"])
    return rounded(out.withColumn("nulls", F.col("nulls").cast("bigint")))


G13_SQL = f"""{GRADED_Q}
SELECT round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(median(pred), 6) AS median_pred FROM graded"""


@register("g13_accuracy_median", G13_SQL)
def g13_accuracy_median(spark, sf_dir):
    """Overall accuracy and exact median."""
    return rounded(AG.accuracy_and_median(_graded(spark, sf_dir), "correct", "pred"))


G14_SQL = f"""{GRADED_Q},
e AS (SELECT CAST(level AS VARCHAR) AS level, CASE WHEN question_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset,
  CASE WHEN pred IS NULL THEN 'No answer' WHEN length(completion) < 30 THEN 'Incomplete' ELSE 'Other' END AS error_type
  FROM graded WHERE NOT correct)
SELECT dataset, NULL::VARCHAR AS level, error_type, count(*) AS count FROM e GROUP BY dataset, error_type
UNION ALL SELECT NULL, level, error_type, count(*) FROM e GROUP BY level, error_type"""


@register("g14_error_counts_two_ways", G14_SQL)
def g14_error_counts_two_ways(spark, sf_dir):
    """Error-type counts by dataset and by level in one grouping-sets pass."""
    g = _graded(spark, sf_dir, "n_chars").filter(~F.col("correct"))
    et = F.when(F.col("pred").isNull(), "No answer").when(F.col("n_chars") < 30, "Incomplete").otherwise("Other")
    e = g.select(F.col("level").cast("string").alias("level"),
                 F.when(F.col("question_id") % 2 == 0, "even").otherwise("odd").alias("dataset"), et.alias("error_type"))
    return AG.counts_two_ways(e, "dataset", "level", "error_type")


G16_SQL = """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id) AS n_augmented FROM events"""


@register("g16_attach_group_size", G16_SQL)
def g16_attach_group_size(spark, sf_dir):
    """Rows per source attached to each row (aggregate + join)."""
    e = dt.table(spark, sf_dir, "events").select("event_id", "user_id")
    return AG.attach_group_size(e, "user_id")


G17_SQL = """WITH r AS (SELECT event_id, user_id, event_type,
  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT event_id, user_id, event_type FROM r WHERE prev IS NULL OR prev IS DISTINCT FROM event_type"""


@register("g17_drop_consecutive_repeats", G17_SQL)
def g17_drop_consecutive_repeats(spark, sf_dir):
    """Drop an event equal to the previous one of the same user."""
    e = dt.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return AG.drop_consecutive_repeats(e, "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "event_type")


G18_SQL = """SELECT l_orderkey AS source_idx, l_returnflag AS level,
  arg_max(l_linenumber, struct_pack(nov := l_discount, dif := l_tax, neg := -l_linenumber, q := -l_quantity)) AS l_linenumber,
  arg_max(l_discount, struct_pack(nov := l_discount, dif := l_tax, neg := -l_linenumber, q := -l_quantity)) AS novelty,
  arg_max(l_tax, struct_pack(nov := l_discount, dif := l_tax, neg := -l_linenumber, q := -l_quantity)) AS difficulty
FROM lineitem GROUP BY l_orderkey, l_returnflag"""


@register("g18_best_candidate", G18_SQL)
def g18_best_candidate(spark, sf_dir):
    """Best candidate per (source, level) by (novelty, difficulty), first wins ties."""
    li = dt.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source_idx"), F.col("l_returnflag").alias("level"), "l_linenumber",
        F.col("l_discount").alias("novelty"), F.col("l_tax").alias("difficulty"), "l_quantity")
    score = F.struct("novelty", "difficulty", (-F.col("l_linenumber")).alias("n"), (-F.col("l_quantity")).alias("q"))
    b = AG.best_per_group(li.withColumn("_s", score), ["source_idx", "level"], F.col("_s"))
    return b.select("source_idx", "level", "l_linenumber", "novelty", "difficulty")


G19_SQL = """SELECT o_custkey AS seed_id, list({'reward': o_totalprice, 'text': o_orderpriority} ORDER BY o_totalprice DESC, o_orderpriority DESC) AS candidates,
  max_by({'reward': o_totalprice, 'text': o_orderpriority}, {'reward': o_totalprice, 'text': o_orderpriority}) AS best
FROM orders GROUP BY o_custkey"""


@register("g19_rank_by_reward", G19_SQL)
def g19_rank_by_reward(spark, sf_dir):
    """Candidates per prompt ranked by reward, with the best kept."""
    o = dt.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("seed_id"),
                                                F.col("o_totalprice").alias("reward"), F.col("o_orderpriority").alias("text"))
    return AG.ranked_list(o, ["seed_id"], "reward", "text")


G21_SQL = """SELECT o_orderpriority AS level, min(o_totalprice) AS min, round(quantile_cont(o_totalprice, 0.25), 6) AS q1,
  round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS max
FROM orders GROUP BY o_orderpriority"""


@register("g21_five_numbers", G21_SQL)
def g21_five_numbers(spark, sf_dir):
    """Five-number summary per group."""
    o = dt.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("level"), "o_totalprice")
    return rounded(AG.five_numbers(o, ["level"], "o_totalprice"))


G22_SQL = f"""{_pq_sql()}
SELECT level, round(avg(CAST(passed AS DOUBLE)), 6) AS mean_pass,
  round((SELECT avg(CAST(passed AS DOUBLE)) FROM pq WHERE level = 1), 6) AS reference_line FROM pq GROUP BY level"""


@register("g22_reference_line", G22_SQL)
def g22_reference_line(spark, sf_dir):
    """Per-level mean with one level's mean as a reference line."""
    pq = _pq(spark, sf_dir)
    ref = pq.filter(F.col("level") == 1).agg(F.avg(F.col("passed").cast("double")).alias("reference_line"))
    per = pq.groupBy("level").agg(F.avg(F.col("passed").cast("double")).alias("mean_pass"))
    return rounded(per.crossJoin(F.broadcast(ref)))
