"""Queries: statistics (X) over document features vs a 0/1 outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..operators import aggregate as AG
from ..operators import stats as X
from . import driver_tables as dt
from ..session import materialised
from .registry import register, rounded

WS = r"[ \t\n\x0B\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
METRICS = ["n_chars", "word_count", "operator_count", "step_count", "logp_sum"]
SWEPT = ["logp_sum", "word_count", "quality"]


def all_metrics(spark, sf_dir):
    """All documents with text features and a pseudo log-prob score."""
    d = dt.table(spark, sf_dir, "documents")
    d = d.select("doc_id", "lang", "n_chars", TX.word_count("text").cast("bigint").alias("word_count"),
                 TX.operator_count("text").cast("bigint").alias("operator_count"),
                 TX.step_count_v2("text").cast("bigint").alias("step_count"))
    return d.withColumn("logp_sum", -(F.col("n_chars") * 0.01 + F.col("operator_count") + 1))


def doc_metrics(spark, sf_dir):
    """The labelled ones (for queries that use a label): texts become numbers before the join."""
    lab = dt.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return all_metrics(spark, sf_dir).join(lab, "doc_id")


def stored_metrics(spark, sf_dir, *columns):
    """``doc_metrics`` (or the named columns) written once, for queries that pass over it several times: texts are
    scanned once, and only for the features that are used."""
    d = doc_metrics(spark, sf_dir)
    return materialised(d.select(*columns) if columns else d, "doc-metrics")


ALL_SQL = f"""am AS (
  SELECT doc_id, lang, n_chars,
    CAST(len(list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '')) AS BIGINT) AS word_count,
    CAST(length(text) - length(translate(text, '+-*/', '')) AS BIGINT) AS operator_count,
    CAST(CASE WHEN len(regexp_extract_all(lower(text), '(step\\s+\\d+|first|second|third|fourth|fifth|next|finally|lastly)')) > 0
         THEN len(regexp_extract_all(lower(text), '(step\\s+\\d+|first|second|third|fourth|fifth|next|finally|lastly)'))
         ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS BIGINT) AS step_count,
    -(CAST(n_chars AS DOUBLE) * CAST(0.01 AS DOUBLE) + CAST(length(text) - length(translate(text, '+-*/', '')) AS DOUBLE) + 1.0::DOUBLE) AS logp_sum
  FROM documents)"""
DOC_SQL = f"""{ALL_SQL},
dm AS (SELECT am.*, quality, toxic FROM am JOIN labels USING (doc_id))"""


def _pearson_sql(x, y):
    return (f"CASE WHEN var_samp({x}) > 0 AND var_samp({y}) > 0 THEN covar_samp({x}, {y}) / sqrt(var_samp({x}) * var_samp({y})) END")


X01_SQL = f"""WITH {DOC_SQL}
""" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, count(*) AS n, CAST(0 AS BIGINT) AS nulls, round({_pearson_sql(m, 'quality')}, 6) AS pearson FROM dm"
    for m in METRICS)


@register("x01_pearson_table", X01_SQL)
def x01_pearson_table(spark, sf_dir):
    """Pearson r of each feature with the 0/1 quality label."""
    out = X.correlation_table(doc_metrics(spark, sf_dir), METRICS, "quality")
    return rounded(out.withColumn("nulls", F.col("nulls").cast("bigint")))


def _avg_rank_sql(x, part=""):
    p = f"PARTITION BY {part} " if part else ""
    pp = f"{part}, " if part else ""
    return f"(rank() OVER ({p}ORDER BY {x}) + (count(*) OVER (PARTITION BY {pp}{x}) - 1) / 2.0)"


X02_SQL = f"""WITH {DOC_SQL}
""" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, count(*) AS n, round({_pearson_sql('rx', 'ry')}, 6) AS spearman FROM "
    f"(SELECT {_avg_rank_sql(m)} AS rx, {_avg_rank_sql('quality')} AS ry FROM dm)"
    for m in METRICS)


@register("x02_spearman_table", X02_SQL)
def x02_spearman_table(spark, sf_dir):
    """Spearman rho of each feature with the 0/1 label: one distributed rank job for all features."""
    return rounded(X.spearman_binary(stored_metrics(spark, sf_dir), METRICS, "quality"))


def _t_two_sided_sql(t, dof):
    """Two-sided p of Student's t by Simpson integration of its density, after x = sqrt(dof) tan(u): the density
    becomes cos(u)^(dof - 1) up to a constant, integrated from 0 to atan(|t| / sqrt(dof)) and to pi / 2."""
    def area(upper):
        w = "CASE WHEN k = 0 OR k = 2000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
        return f"(SELECT sum({w} * pow(greatest(cos({upper} * k / 2000), 0), {dof} - 1)) * {upper} / 6000 FROM range(2001) s(k))"
    return f"(1 - {area(f'atan(abs({t}) / sqrt({dof}))')} / {area('(pi() / 2)')})"


_R_T = "{r} * sqrt((n - 2) / greatest(1 - {r} * {r}, 1e-300))"
X03_SQL = f"""WITH {DOC_SQL},
r AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, count(*) AS n, {_pearson_sql(m, 'quality')} AS pearson, "
    f"(SELECT {_pearson_sql('rx', 'ry')} FROM (SELECT {_avg_rank_sql(m)} AS rx, {_avg_rank_sql('quality')} AS ry FROM dm)) AS spearman FROM dm"
    for m in METRICS) + f"""),
t AS (SELECT *, {_R_T.format(r='pearson')} AS tp, {_R_T.format(r='spearman')} AS ts FROM r)
SELECT metric, n, round(pearson, 6) AS pearson, round({_t_two_sided_sql('tp', '(n - 2)')}, 6) AS pearson_p,
  round(spearman, 6) AS spearman, round({_t_two_sided_sql('ts', '(n - 2)')}, 6) AS spearman_p FROM t"""


@register("x03_correlation_pvalues", X03_SQL)
def x03_correlation_pvalues(spark, sf_dir):
    """Pearson and Spearman with two-sided p-values (t distribution, n - 2 df)."""
    d = stored_metrics(spark, sf_dir)
    t = X.correlation_table(d, METRICS, "quality").drop("nulls").join(X.spearman_binary(d, METRICS, "quality").select("metric", "spearman"), "metric")
    return rounded(t.select("metric", "n", "pearson", X.corr_pvalue(F.col("pearson"), F.col("n")).alias("pearson_p"),
                            "spearman", X.corr_pvalue(F.col("spearman"), F.col("n")).alias("spearman_p")))


X06_SQL = f"""WITH {ALL_SQL},
rk AS (SELECT *, {', '.join(f"{_avg_rank_sql(m)} AS r_{m}" for m in METRICS)} FROM am)
""" + "\nUNION ALL\n".join(
    f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, round({_pearson_sql(a, b)}, 6) AS pearson, "
    f"round({_pearson_sql('r_' + a, 'r_' + b)}, 6) AS spearman FROM rk"
    for i, a in enumerate(METRICS) for b in METRICS[i + 1:])


@register("x06_correlation_matrix", X06_SQL)
def x06_correlation_matrix(spark, sf_dir):
    """Pairwise Pearson and Spearman matrix in long form over all documents."""
    return rounded(X.correlation_matrix(materialised(all_metrics(spark, sf_dir), "doc-metrics"), METRICS, "doc_id"))


X07_SQL = f"""WITH {DOC_SQL},
a AS (SELECT i AS alpha_idx, -1.0 + i * 3.0 / 300 AS alpha FROM range(301) t(i)),
s AS (SELECT alpha_idx, alpha, logp_sum / pow(CAST(word_count AS DOUBLE), alpha) AS score, quality FROM dm, a),
r AS (SELECT alpha_idx, alpha, quality, {_avg_rank_sql('score', 'alpha_idx')} AS rk FROM s)
SELECT CAST(alpha_idx AS INTEGER) AS alpha_idx, round(alpha, 6) AS alpha, count(*) AS n,
  round({_pearson_sql('rk', 'quality')}, 6) AS spearman
FROM r GROUP BY alpha_idx, alpha"""


@register("x07_alpha_sweep", X07_SQL)
def x07_alpha_sweep(spark, sf_dir):
    """Spearman of logp_sum / n^alpha with quality over 301 alphas, closed
    form per alpha from distinct (score, count, positives)."""
    return rounded(X.alpha_sweep(stored_metrics(spark, sf_dir, *SWEPT), "logp_sum", "word_count", "quality"))


X07B_SQL = f"""WITH {DOC_SQL},
a AS (SELECT i AS alpha_idx, -1.0 + i * 3.0 / 300 AS alpha FROM range(301) t(i)),
s AS (SELECT alpha_idx, alpha, logp_sum / pow(CAST(word_count AS DOUBLE), alpha) AS score, quality FROM dm, a),
r AS (SELECT alpha_idx, alpha, quality, {_avg_rank_sql('score', 'alpha_idx')} AS rk FROM s),
sw AS (SELECT alpha_idx, alpha, {_pearson_sql('rk', 'quality')} AS spearman FROM r GROUP BY alpha_idx, alpha)
SELECT round(arg_max(alpha, (abs(spearman), -alpha_idx)), 6) AS alpha,
  round(arg_max(spearman, (abs(spearman), -alpha_idx)), 6) AS spearman FROM sw WHERE spearman IS NOT NULL"""


@register("x07b_best_alpha", X07B_SQL)
def x07b_best_alpha(spark, sf_dir):
    """Alpha with the largest |rho|, earliest alpha wins ties."""
    return rounded(X.best_alpha(X.alpha_sweep(stored_metrics(spark, sf_dir, *SWEPT), "logp_sum", "word_count", "quality")))


X08_SQL = f"""WITH b AS ({X07B_SQL.replace('round(arg_max(alpha, (abs(spearman), -alpha_idx)), 6) AS alpha', 'arg_max(alpha, (abs(spearman), -alpha_idx)) AS alpha')}),
{DOC_SQL},
s AS (SELECT logp_sum / pow(CAST(word_count AS DOUBLE), (SELECT alpha FROM b)) AS score, quality FROM dm),
k AS (SELECT score, quality, {_avg_rank_sql('score')} AS rk FROM s),
r AS (SELECT count(*) AS n, {_pearson_sql('score', 'quality')} AS pearson, {_pearson_sql('rk', 'quality')} AS spearman FROM k),
t AS (SELECT *, {_R_T.format(r='pearson')} AS tp, {_R_T.format(r='spearman')} AS ts FROM r)
SELECT (SELECT round(alpha, 6) FROM b) AS alpha, n, round(pearson, 6) AS pearson, round({_t_two_sided_sql('tp', '(n - 2)')}, 6) AS pearson_p,
  round(spearman, 6) AS spearman, round({_t_two_sided_sql('ts', '(n - 2)')}, 6) AS spearman_p FROM t"""


@register("x08_correlations_at_best_alpha", X08_SQL)
def x08_correlations_at_best_alpha(spark, sf_dir):
    """Pearson and Spearman with p-values at the best alpha of the sweep."""
    d = stored_metrics(spark, sf_dir, *SWEPT)
    best = X.best_alpha(X.alpha_sweep(d, "logp_sum", "word_count", "quality")).first()
    return rounded(X.correlations_at_alpha(d, "logp_sum", "word_count", "quality", best["alpha"]))


X09_SQL = f"""WITH {DOC_SQL},
g AS (SELECT count(*) FILTER (WHERE quality = 1) AS n1, avg(n_chars) FILTER (WHERE quality = 1) AS m1,
  var_samp(n_chars) FILTER (WHERE quality = 1) AS v1, count(*) FILTER (WHERE quality = 0) AS n2,
  avg(n_chars) FILTER (WHERE quality = 0) AS m2, var_samp(n_chars) FILTER (WHERE quality = 0) AS v2 FROM dm)
SELECT n1, n2, round(m1, 6) AS m1, round(m2, 6) AS m2, round(v1, 6) AS v1, round(v2, 6) AS v2,
  round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t,
  round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 6) AS dof
FROM g"""


@register("x09_welch_t", X09_SQL)
def x09_welch_t(spark, sf_dir):
    """Welch t statistic and degrees of freedom (p in x09b)."""
    return rounded(X.welch_test(doc_metrics(spark, sf_dir), "quality", "n_chars").drop("p_value"))


X09B_SQL = f"""WITH w AS ({X09_SQL.replace('round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) AS t', '(m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t').replace('/ (n2 - 1)), 6) AS dof', '/ (n2 - 1))) AS dof').replace('  round(pow(v1', '  (pow(v1')})
SELECT n1, n2, m1, m2, v1, v2, round(t, 6) AS t, round(dof, 6) AS dof, round({_t_two_sided_sql('t', 'dof')}, 6) AS p_value FROM w"""


@register("x09b_welch_pvalue", X09B_SQL)
def x09b_welch_pvalue(spark, sf_dir):
    """Welch test with its two-sided p-value."""
    return rounded(X.welch_test(doc_metrics(spark, sf_dir), "quality", "n_chars"))


X10_SQL = f"""WITH {ALL_SQL}
SELECT doc_id, round((n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER (), 6) AS n_chars_z FROM am"""


@register("x10_standardise", X10_SQL)
def x10_standardise(spark, sf_dir):
    """Z-score with the population standard deviation."""
    return rounded(X.standardise(all_metrics(spark, sf_dir), "n_chars").select("doc_id", "n_chars_z"))


X11_SQL = f"""WITH {DOC_SQL},
st AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, count(*) AS n FROM dm),
g AS (SELECT CAST(i AS INTEGER) AS idx, lo + i * (hi - lo) / 99 AS threshold, n FROM st, range(100) t(i))
SELECT idx, round(threshold, 6) AS threshold, round(count(dm.doc_id) / n, 6) AS coverage,
  round(avg(CAST(dm.quality AS DOUBLE)), 6) AS accuracy
FROM g LEFT JOIN dm ON dm.n_chars > g.threshold GROUP BY idx, threshold, n"""


@register("x11_accuracy_coverage", X11_SQL)
def x11_accuracy_coverage(spark, sf_dir):
    """X11: coverage and accuracy above 100 thresholds (bucketed, one aggregate)."""
    return rounded(X.accuracy_coverage(doc_metrics(spark, sf_dir), "n_chars", "quality", 100))


X13_SQL = f"""WITH {DOC_SQL},
st AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM dm),
b AS (SELECT quality, CAST(CASE WHEN hi > lo THEN least(floor((n_chars - lo) / ((hi - lo) / 50)), 49) ELSE 0 END AS INTEGER) AS bin, lo, hi
      FROM dm, st),
c AS (SELECT quality, bin, lo, hi, count(*) AS count FROM b GROUP BY ALL),
t AS (SELECT quality, count(*) AS tot FROM dm GROUP BY quality)
SELECT quality, bin, round(lo + bin * ((hi - lo) / 50), 6) AS bin_start, count,
  round(count / (tot * ((hi - lo) / 50)), 6) AS density FROM c JOIN t USING (quality)"""


@register("x13_histogram", X13_SQL)
def x13_histogram(spark, sf_dir):
    """50-bin histogram with density normalised per label."""
    return rounded(X.histogram(doc_metrics(spark, sf_dir), "n_chars", "quality", 50))


X15_SQL = f"""WITH {ALL_SQL},
st AS (SELECT min(n_chars) xl, max(n_chars) xh, min(word_count) yl, max(word_count) yh FROM am)
SELECT CAST(CASE WHEN xh > xl THEN least(floor((n_chars - xl) / ((xh - xl) / 20)), 19) ELSE 0 END AS INTEGER) AS x_bin,
  CAST(CASE WHEN yh > yl THEN least(floor((word_count - yl) / ((yh - yl) / 20)), 19) ELSE 0 END AS INTEGER) AS y_bin,
  count(*) AS count FROM am, st GROUP BY ALL"""


@register("x15_bins_2d", X15_SQL)
def x15_bins_2d(spark, sf_dir):
    """Joint 20 x 20 binned counts."""
    return X.bins_2d(all_metrics(spark, sf_dir), "n_chars", "word_count", 20)


X15B_SQL = f"""WITH {ALL_SQL},
st AS (SELECT min(n_chars) xl, max(n_chars) xh, min(word_count) yl, max(word_count) yh FROM am),
p AS (SELECT xl, xh, yl, yh, CASE WHEN xh > xl THEN (n_chars - xl) / ((xh - xl) / 20.0::DOUBLE) ELSE 0 END AS u,
        CASE WHEN yh > yl THEN (word_count - yl) / ((yh - yl) / 11.0::DOUBLE) ELSE 0 END AS v FROM am, st),
n AS (SELECT *, pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) AS near FROM p),
b AS (SELECT xl, xh, yl, yh, CASE WHEN near THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN near THEN floor(u + 0.5) ELSE floor(u) END AS INTEGER) AS x_bin,
        CAST(CASE WHEN near THEN floor(v + 0.5) ELSE floor(v) END AS INTEGER) AS y_bin FROM n)
SELECT lattice, x_bin, y_bin, round(xl + (x_bin + lattice * 0.5::DOUBLE) * (xh - xl) / 20.0::DOUBLE, 6) AS x_centre,
  round(yl + (y_bin + lattice * 0.5::DOUBLE) * (yh - yl) / 11.0::DOUBLE, 6) AS y_centre, count(*) AS count FROM b GROUP BY ALL"""


@register("x15b_hexagons", X15B_SQL)
def x15b_hexagons(spark, sf_dir):
    """Joint counts on a grid of hexagons, 20 across."""
    return rounded(X.hexagons(all_metrics(spark, sf_dir), "n_chars", "word_count", 20))


X16_SQL = f"""WITH {DOC_SQL},
st AS (SELECT min(n_chars) lo, max(n_chars) hi FROM dm),
b AS (SELECT CAST(CASE WHEN hi > lo THEN greatest(least(ceil((n_chars - lo) / ((hi - lo) / 10)) - 1, 9), 0) ELSE 0 END AS INTEGER) AS bin,
  quality FROM dm, st)
SELECT bin, count(*) AS n, round(avg(CAST(quality AS DOUBLE)), 6) AS mean_quality FROM b GROUP BY bin"""


@register("x16_equal_width_bins", X16_SQL)
def x16_equal_width_bins(spark, sf_dir):
    """Right-closed equal-width bins and the mean outcome per bin."""
    b = X.equal_width_right_closed(doc_metrics(spark, sf_dir), "n_chars", 10)
    return rounded(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"),
                                        F.avg(F.col("quality").cast("double")).alias("mean_quality")))


X17_SQL = f"""WITH {ALL_SQL}
SELECT CASE WHEN word_count > 0 AND word_count <= 10 THEN '(0,10]' WHEN word_count > 10 AND word_count <= 20 THEN '(10,20]'
  WHEN word_count > 20 AND word_count <= 50 THEN '(20,50]' WHEN word_count > 50 AND word_count <= 100 THEN '(50,100]'
  WHEN word_count > 100 THEN '(100,max]' END AS bucket, count(*) AS n FROM am GROUP BY 1"""


@register("x17_fixed_edge_buckets", X17_SQL)
def x17_fixed_edge_buckets(spark, sf_dir):
    """Fixed right-closed token-count buckets."""
    d = all_metrics(spark, sf_dir)
    b = X.fixed_edges("word_count", [0, 10, 20, 50, 100], ["(0,10]", "(10,20]", "(20,50]", "(50,100]", "(100,max]"])
    return d.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


X19_SQL = f"""WITH {DOC_SQL}
SELECT lang, round(regr_slope(quality, n_chars), 9) AS slope, round(regr_intercept(quality, n_chars), 6) AS intercept,
  round(regr_r2(quality, n_chars), 6) AS r2, CAST(regr_count(quality, n_chars) AS BIGINT) AS n FROM dm GROUP BY lang"""


@register("x19_trend", X19_SQL)
def x19_trend(spark, sf_dir):
    """Linear trend of the outcome on a feature per group."""
    t = X.trend(doc_metrics(spark, sf_dir), ["lang"], "quality", "n_chars")
    return t.select("lang", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"),
                    F.round("r2", 6).alias("r2"), F.col("n").cast("bigint"))


X23_SQL = f"""WITH {DOC_SQL}
SELECT quality, round(avg(CAST(n_chars AS DOUBLE)), 6) AS mean_n_chars, round(avg(CAST(word_count AS DOUBLE)), 6) AS mean_word_count
FROM dm GROUP BY quality"""


@register("x23_group_mean_lines", X23_SQL)
def x23_group_mean_lines(spark, sf_dir):
    """Per-label mean lines."""
    return rounded(AG.mean_by(doc_metrics(spark, sf_dir), ["quality"], ["n_chars", "word_count"]))


_X12_DRAW = f"((w0 % {X.DRAW_PRIME} * place + w1) % {X.DRAW_PRIME} * place + w2) % {X.DRAW_PRIME}"
X12_SQL = f"""WITH {DOC_SQL},
c AS (SELECT quality, n_chars::DOUBLE AS x, count(*) AS c FROM dm WHERE n_chars IS NOT NULL GROUP BY ALL),
m AS (SELECT quality, x, c, md5('42|' || CASE WHEN quality IS NULL THEN '{{}}' ELSE '{{"quality":' || quality || '}}' END || '|' || (round(x * 1000000)::HUGEINT)) AS h FROM c),
k AS (SELECT quality, x, c, ('0x' || substr(h, 1, 8))::BIGINT AS w0, ('0x' || substr(h, 9, 8))::BIGINT AS w1, ('0x' || substr(h, 17, 8))::BIGINT AS w2 FROM m),
u AS (SELECT quality, x, c, rep, i, w0, w1, w2, (rep * {X.DRAW_UNITS} + 1 + i) % {X.DRAW_PRIME} AS place
      FROM k, range(2000) r(rep), range({X.DRAW_UNITS}) t(i) WHERE i < c OR (c > {X.DRAW_UNITS} AND i < 2)),
d AS (SELECT quality, x, c, rep, i, {_X12_DRAW} AS draw FROM u),
w AS (SELECT quality, x, rep, CASE WHEN c <= {X.DRAW_UNITS} THEN sum({" + ".join(f"(draw >= {e})::INT" for e in X.poisson_edges())})::DOUBLE
        ELSE greatest(0, floor(c + sqrt(c) * sqrt(-2 * ln(max(CASE WHEN i = 0 THEN (draw + 0.5) / {X.DRAW_PRIME} END)))
                                 * cos(2 * pi() * max(CASE WHEN i = 1 THEN (draw + 0.5) / {X.DRAW_PRIME} END)) + 0.5)) END AS w
      FROM d GROUP BY quality, x, c, rep),
s AS (SELECT quality, rep, sum(w * x) / nullif(sum(w), 0) AS m FROM w GROUP BY ALL),
q AS (SELECT quality, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM s GROUP BY ALL),
g AS (SELECT quality, count(n_chars) AS n, avg(n_chars) AS mean FROM dm GROUP BY ALL)
SELECT g.quality, n, round(mean, 6) AS mean, round(2 * mean - hi, 6) AS ci_low, round(2 * mean - lo, 6) AS ci_high
FROM g LEFT JOIN q ON q.quality IS NOT DISTINCT FROM g.quality"""


@register("x12_bootstrap_ci", X12_SQL)
def x12_bootstrap_ci(spark, sf_dir):
    """Basic 95 % bootstrap CI of mean n_chars per label (Poisson
    bootstrap, 2,000 replicates by counter-based draws)."""
    return rounded(X.bootstrap_mean_ci(doc_metrics(spark, sf_dir), ["quality"], "n_chars", replicates=2_000))


X14_SQL = f"""WITH {DOC_SQL},
st AS (SELECT quality, min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi, count(*) AS n,
         stddev_samp(n_chars) * pow(count(*)::DOUBLE, -0.2) AS bw FROM dm GROUP BY quality),
b AS (SELECT quality, lo, hi, n, bw, lo + (CASE WHEN hi > lo THEN least(floor((n_chars - lo) / ((hi - lo) / 2048)), 2047) ELSE 0 END + 0.5) * ((hi - lo) / 2048) AS ctr
      FROM dm JOIN st USING (quality)),
c AS (SELECT quality, lo, hi, n, bw, ctr, count(*) AS c FROM b GROUP BY ALL),
g AS (SELECT *, lo - 3 * bw + i * (hi - lo + 6 * bw) / 99 AS x FROM c, range(100) t(i))
SELECT quality, CAST(i AS INTEGER) AS grid_idx, round(x, 6) AS x,
  round(sum(c * exp(-0.5 * pow((x - ctr) / bw, 2)) / (bw * sqrt(2 * pi()))) / max(n), 6) AS density FROM g GROUP BY quality, i, x"""


@register("x14_kde_grid", X14_SQL)
def x14_kde_grid(spark, sf_dir):
    """Binned Gaussian KDE of n_chars per label on a 100-point grid."""
    return rounded(X.kde_grid(doc_metrics(spark, sf_dir), "n_chars", ["quality"], grid_points=100))


def _newton_sql(steps=14):
    """Newton steps of a one-feature logistic fit on the standardised feature, one CTE each."""
    out = ["x AS (SELECT (n_chars - avg(n_chars) OVER ()) / stddev_pop(n_chars) OVER () AS z, quality::DOUBLE AS y FROM dm)",
           "b0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"]
    for i in range(steps):
        out.append(f"""s{i} AS (SELECT any_value(a) AS a, any_value(b) AS b, sum(y - p) AS g0, sum((y - p) * z) AS g1,
  sum(p * (1 - p)) AS h00, sum(p * (1 - p) * z) AS h01, sum(p * (1 - p) * z * z) AS h11
  FROM (SELECT z, y, a, b, 1 / (1 + exp(-(a + b * z))) AS p FROM x, b{i}))""")
        out.append(f"""b{i + 1} AS (SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a,
  b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b FROM s{i})""")
    return ",\n".join(out), f"b{steps}"


_NEWTON, _LAST = _newton_sql()
X20_SQL = f"""WITH {DOC_SQL},
{_NEWTON},
st AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi, avg(n_chars) AS mu, stddev_pop(n_chars) AS sd FROM dm),
f AS (SELECT a - b * mu / sd AS intercept, b / sd AS slope, lo, hi FROM {_LAST}, st)
SELECT 'n_chars' AS metric, round(intercept, 4) AS intercept, round(slope, 8) AS slope, round(lo + i * (hi - lo) / 49, 6) AS x,
  round(1 / (1 + exp(-(intercept + slope * (lo + i * (hi - lo) / 49)))), 4) AS p FROM f, range(50) t(i)"""


@register("x20_logistic_curve", X20_SQL)
def x20_logistic_curve(spark, sf_dir):
    """Logistic curve of quality on n_chars."""
    out = X.logistic_curve(doc_metrics(spark, sf_dir), "n_chars", "quality", 50)
    return out.select("metric", F.round("intercept", 4).alias("intercept"), F.round("slope", 8).alias("slope"), F.round("x", 6).alias("x"), F.round("p", 4).alias("p"))


X21_SQL = f"""WITH {DOC_SQL},
st AS (SELECT min(n_chars)::DOUBLE AS lo, max(n_chars)::DOUBLE AS hi FROM dm),
g AS (SELECT i, lo + i * (hi - lo) / 39 AS gx, 0.3 * (hi - lo) AS h FROM st, range(40) t(i)),
w AS (SELECT i, gx, n_chars::DOUBLE AS x, quality::DOUBLE AS y, pow(1 - pow(abs(n_chars - gx) / h, 3), 3) AS w FROM dm, g WHERE abs(n_chars - gx) < h),
m AS (SELECT i, gx, sum(w) AS s0, sum(w * x) AS s1, sum(w * x * x) AS s2, sum(w * y) AS t0, sum(w * x * y) AS t1 FROM w GROUP BY i, gx)
SELECT CAST(i AS INTEGER) AS grid_idx, round(gx, 6) AS x,
  round(t0 / s0 + (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) * (gx - s1 / s0), 4) AS y_hat FROM m"""


@register("x21_local_linear_trend", X21_SQL)
def x21_local_linear_trend(spark, sf_dir):
    """Tricube-weighted local linear trend of quality on n_chars."""
    out = X.local_linear(doc_metrics(spark, sf_dir), "n_chars", "quality", grid_points=40)
    return out.select("grid_idx", F.round("x", 6).alias("x"), F.round("y_hat", 4).alias("y_hat"))


def _lowess_sql(points: int, frac: str, rounds: int) -> str:
    last = points - 1
    fit = lambda k, r: f"""m{k} AS (SELECT i, gx, sum(w) AS s0, sum(w * (x - gx)) AS s1, sum(w * (x - gx) * (x - gx)) AS s2, sum(w * y) AS t0, sum(w * (x - gx) * y) AS t1
  FROM (SELECT i, gx, x, y, {r} * CASE WHEN x = gx THEN 1 ELSE pow(1 - pow(abs(x - gx) / h, 3), 3) END AS w FROM r{k}, h WHERE abs(x - gx) < h OR x = gx) GROUP BY ALL),
f{k} AS (SELECT list((s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ORDER BY i) AS f FROM m{k})"""  # noqa: E731
    parts = [f"""d AS (SELECT n_chars::DOUBLE AS x, word_count::DOUBLE AS y FROM dm WHERE n_chars IS NOT NULL AND word_count IS NOT NULL),
st AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM d),
g AS (SELECT i, lo + i * (hi - lo) / {last} AS gx, n FROM st, range({points}) t(i)),
h AS (SELECT i, gx, list(abs(x - gx) ORDER BY abs(x - gx))[CAST(floor({frac} * any_value(n) + 1e-10) AS BIGINT)] AS h FROM d, g GROUP BY i, gx),
r0 AS (SELECT x, y, 1.0::DOUBLE AS r FROM d)""", fit(0, "r")]
    for k in range(1, rounds + 1):
        parts.append(f"""e{k} AS (SELECT x, y, abs(y - (f[j + 1] + (x - (lo + j * (hi - lo) / {last})) / ((hi - lo) / {last}) * (f[j + 2] - f[j + 1]))) AS e
  FROM (SELECT x, y, f, lo, hi, CAST(least(floor((x - lo) / ((hi - lo) / {last})), {points - 2}) AS BIGINT) AS j FROM d, f{k - 1}, st)),
r{k} AS (SELECT x, y, CASE WHEN e < s THEN pow(1 - pow(e / s, 2), 2) ELSE 0 END AS r FROM e{k}, (SELECT 6 * median(e) AS s FROM e{k}))""")
        parts.append(fit(k, "r"))
    return f"WITH {DOC_SQL}, " + ", ".join(parts) + f" SELECT CAST(i AS INTEGER) AS grid_idx, round(gx, 6) AS x, round(f[i + 1], 4) AS y_hat FROM g, f{rounds}"


@register("x21b_lowess", _lowess_sql(40, "(2.0::DOUBLE / 3)", 3))
def x21b_lowess(spark, sf_dir):
    """Robust lowess of word_count on n_chars, two thirds of the rows a window, three rounds."""
    out = X.lowess(doc_metrics(spark, sf_dir), "n_chars", "word_count")
    return out.select("grid_idx", F.round("x", 6).alias("x"), F.round("y_hat", 4).alias("y_hat"))
