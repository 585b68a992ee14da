"""Driver contract: entry() runs; every query runs on sf0.001; oracle SQL
matches on a sample of queries."""

import duckdb
import pytest

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    df = e.entry(spark)
    assert df.count() >= 0
    assert "pass_at_1" in df.columns


def test_every_oracle_key_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["m01_pass_at_k_by_level", "a02_six_way", "p05_add_row_id", "x07_alpha_sweep",
                                  "g17_drop_consecutive_repeats", "d03_tokenise_and_mask"])
def test_oracle_sample(spark, name):
    import scripts.check_oracle as chk
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = e.queries()[name](spark, SF)
    res = con.execute(e.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert chk.rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == chk.rows_of(dcols, res.fetchall())
