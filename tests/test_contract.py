import duckdb
import pytest

import __spark_entry__ as contract
from scripts.check import TABLES, canon, norm

SF = "/root/testdata/sf0.001"
SAMPLE = ["s1_find_cases", "p6_t_label", "j8_comparable_pairs", "a12_cindex_library", "r4_best_rule", "v13_node_measures",
          "v15_cleaned_mask", "v4_crop_box_small_slab", "v24_dice", "v32_centroid_spread", "v45_dependences", "m1_impute_scale_params",
          "m14_cox_score_at_fixed", "w7_stratified_folds"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_every_inventory_line_has_a_query():
    names = {n.split("_")[0] for n in contract.queries()}
    wanted = ([f"s{i}" for i in range(1, 17)] + [f"p{i}" for i in range(1, 24)] + [f"j{i}" for i in range(1, 13)]
              + [f"v{i}" for i in range(1, 48) if i != 47] + [f"r{i}" for i in range(1, 8)] + [f"a{i}" for i in range(1, 23)]
              + [f"w{i}" for i in range(1, 11)] + [f"m{i}" for i in range(1, 30)] + ["st1"])
    assert not set(wanted) - names


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    got, want = canon(contract.queries()[name](spark, SF).toPandas()), canon(db.sql(contract.oracle_sql()[name]).df())
    rows = lambda d: sorted(tuple(norm(v) for v in r) for r in d.itertuples(index=False))
    assert list(got.columns) == list(want.columns) and rows(got) == rows(want)


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 63
