"""Projection, filtering, sampling, shaping (P1-P23) and joins / set
operations (J1-J12).

Scale notes
* "first per group" and "random one per group" are ``min_by`` aggregates, not
  ``row_number`` windows: an aggregate is combined map-side, so a group that
  holds a third of all rows never lands whole in one task.
* Global positions (``add_row_id``) use range partitioning plus per-partition
  offsets (``ranks.global_index``) instead of an unpartitioned window.
* Joins are plain equi-joins; AQE turns a shuffle join into a broadcast join
  at run time only when the measured side is under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold`` (a size-checked broadcast
  with the shuffle join as the fallback). Explicit ``broadcast`` is used only
  for one-row aggregates and literal lists, whose size is bounded by
  construction.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ranks


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- P1-P4 -----------------------------------------------------------------

def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """P1."""
    return df.withColumnsRenamed(dict(mapping))


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P2."""
    return df.select(*cols)


def ensure_columns(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Add each missing column as a typed NULL."""
    missing = {c: F.lit(None).cast(t) for c, t in cols.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def default_column(df: DataFrame, name: str, default: Column | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Keep ``name`` if present, else fill it with ``default``, or with the
    row number by ``order`` (unique) when no default is given."""
    if name in df.columns:
        return df
    return ranks.global_index(df, order, name) if default is None else df.withColumn(name, default)


def add_row_id(df: DataFrame, order: Sequence[str], name: str = "original_id", start: int = 0) -> DataFrame:
    """P5: dense position by ``order`` (must be unique), starting at ``start``.
    Distributed: range partition + per-partition offsets (no single-task window)."""
    return ranks.global_index(df, order, name, start)


# --- P6-P15 ----------------------------------------------------------------

def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """``isin`` for a literal list, ``left_semi`` join for a DataFrame of keys."""
    if isinstance(values, DataFrame):
        key = values.columns[0]
        return df.join(values.select(F.col(key).alias(col)), col, "left_semi")
    return df.filter(F.col(col).isin(list(values)))


def threshold_filter(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """Rows with col > threshold (e.g. perplexity > 10 = hard)."""
    return df.filter(F.col(col) > F.lit(threshold))


def quantile_filter(df: DataFrame, col: str, q: float = 0.95) -> DataFrame:
    """Rows above the linearly interpolated quantile. The quantile is a
    one-row aggregate, broadcast to the scan (bounded: one row)."""
    cut = ranks.quantiles(df, col, [q]).select(F.col("q_0").alias("_cut"))
    return df.crossJoin(F.broadcast(cut)).filter(F.col(col) > F.col("_cut")).drop("_cut")


def failures(df: DataFrame, cols: Sequence[str], passed: str = "passed") -> DataFrame:
    """Rows that did not pass."""
    return df.filter(~F.coalesce(F.col(passed).cast("boolean"), F.lit(False))).select(*cols)


def drop_missing(df: DataFrame, col: str) -> DataFrame:
    """P10."""
    return df.filter(F.col(col).isNotNull())


def head(df: DataFrame, order: Sequence, n: int, offset: int = 0) -> DataFrame:
    """Rows [offset, offset + n) in ``order``; top-k per partition, then merged."""
    out = df.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out.limit(n)


def first_per_group(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` per group, as a min_by aggregate."""
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def seeded_key(seed, *cols) -> Column:
    """md5 of 'seed|col1|...': a reproducible pseudo-random order, equal in DuckDB."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[_col(c).cast("string") for c in cols]))


def sample_n(df: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """N rows in seeded-hash order; all rows when fewer than n."""
    return df.orderBy(seeded_key(seed, id_col), F.col(id_col)).limit(n)


def random_one_per_group(df: DataFrame, keys: Sequence[str], seed: int, id_col: str) -> DataFrame:
    """One reproducible pseudo-random row per group."""
    return first_per_group(df, keys, F.struct(seeded_key(seed, id_col), F.col(id_col)))


# --- P16-P23 ---------------------------------------------------------------

def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "metric",
         value: str = "value") -> DataFrame:
    """P16."""
    return df.unpivot(list(ids), list(values), var, value)


def map_labels(col, mapping: Mapping, default=None) -> Column:
    """Lookup in a literal map."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = F.element_at(m, _col(col)) if default is None else F.coalesce(F.try_element_at(m, _col(col)), F.lit(default))
    return out


def explode_samples(df: DataFrame, keys: Sequence[str], arrays: Mapping[str, str],
                    pos: str = "sample_number") -> DataFrame:
    """One row per (key, position) from parallel arrays, stopping at the
    shortest array (``arrays_zip`` pads with NULL, so positions past the
    shortest are filtered)."""
    names = list(arrays)
    z = F.arrays_zip(*[F.col(a).alias(n) for n, a in arrays.items()])
    m = F.least(*[F.size(a) for a in arrays.values()])
    e = df.select(*keys, m.alias("_m"), F.posexplode(z).alias(pos, "_z"))
    return e.filter(F.col(pos) < F.col("_m")).select(*keys, pos, *[F.col(f"_z.{n}").alias(n) for n in names])


def collect_samples(df: DataFrame, keys: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """Regroup sample rows into ordered per-question lists. Bounded per
    group by the number of samples requested per question."""
    agg = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *cols))).alias("_s"))
    def field(name):
        return lambda s: s[name]
    return agg.select(*keys, *[F.transform("_s", field(c)).alias(c) for c in cols])


def replicate_k(df: DataFrame, k: int, name: str = "sample_number") -> DataFrame:
    """P20: k prompt rows per question."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def as_levels(parts: Mapping[int, DataFrame], name: str = "level") -> DataFrame:
    """Tag each part with its level and union by name."""
    tagged = [d.withColumn(name, F.lit(lv)) for lv, d in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def level_curves(levels: DataFrame, curves: DataFrame, level: str = "level") -> DataFrame:
    """One-row-per-level curves (e.g. a reference model's pass rate) joined to levelled data; levels without a
    curve keep NULLs."""
    return levels.join(curves, level, "left")


def keep_if_correct(flag, augmented, original) -> Column:
    """Augmented value when judged correct, else the original."""
    return F.when(F.coalesce(_col(flag), F.lit(False)), _col(augmented)).otherwise(_col(original))


# --- J ---------------------------------------------------------------------

def join_suffixed(left: DataFrame, right: DataFrame, on: str, how: str = "inner",
                  suffixes=("_x", "_y")) -> DataFrame:
    """Equi-join; columns present on both sides get suffixes."""
    common = (set(left.columns) & set(right.columns)) - {on}
    lf = left.select(*[F.col(c).alias(c + suffixes[0]) if c in common else F.col(c) for c in left.columns])
    rt = right.select(*[F.col(c).alias(c + suffixes[1]) if c in common else F.col(c) for c in right.columns])
    return lf.join(rt, on, how)


def outer_align(a: DataFrame, b: DataFrame, key: str, a_val: str, b_val: str) -> DataFrame:
    """Full outer join of two keyed counts, missing -> 0."""
    return a.join(b, key, "full_outer").select(
        key, F.coalesce(a_val, F.lit(0)).cast("int").alias(a_val), F.coalesce(b_val, F.lit(0)).cast("int").alias(b_val))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    """J4."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def tag(df: DataFrame, **consts) -> DataFrame:
    """J5."""
    return df.withColumns({k: F.lit(v) for k, v in consts.items()})


def attach_metadata(rows: DataFrame, candidates: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    """Candidate columns (source, level, code, novelty, difficulty) on evaluation rows; rows without a
    candidate keep NULLs. Columns the rows have already are taken from the candidate."""
    return rows.drop(*[c for c in columns if c != on]).join(candidates.select(on, *columns), on, "left")


def rows_at(df: DataFrame, order: Sequence[str], positions: Column, name: str = "position") -> DataFrame:
    """Rows by position in ``order`` (unique); ``positions`` is a condition on the position column."""
    return ranks.global_index(df, order, name).filter(positions)


def full_test_set(df: DataFrame, id_col: str, answer: str) -> DataFrame:
    """Every problem with its position (``original_id``) and its extracted
    solution (A9), ordered by position."""
    from ..functions.answers import hash_text
    return ranks.global_index(df, [id_col], "original_id").withColumn("solution", hash_text(answer)).orderBy("original_id")


def intersect_ids(*frames: DataFrame) -> DataFrame:
    """Ids present in every frame (distinct)."""
    return reduce(lambda a, b: a.intersect(b), [f.select(f.columns[0]) for f in frames])


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """J7."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, done: DataFrame, on: str, as_string: bool = True) -> DataFrame:
    """Drop rows whose id is already done; ids compared as strings."""
    if as_string:
        d = done.select(F.col(on).cast("string").alias("_k"))
        return df.join(d, F.col(on).cast("string") == F.col("_k"), "left_anti")
    return df.join(done.select(on), on, "left_anti")


def verdict_split(df: DataFrame, verdict: Column, name: str = "correctly_augmented"):
    """Flag column plus the two filtered views."""
    flagged = df.withColumn(name, F.coalesce(verdict, F.lit(False)))
    return flagged, flagged.filter(F.col(name)), flagged.filter(~F.col(name))
