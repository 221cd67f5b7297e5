"""Registered queries against their SQL in DuckDB on the smallest tables, and plan checks."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as contract
from check_queries import rows_of
from demandspark import oracle, queries as registry

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "drop_pre_launch",
    "track_dry_monthly",
    "stockout_weekly_flags",
    "eval_all_naive",
    "feature_matrix",
    "fc_seasonal_naive",
    "fc_ets",
    "score_batch",
    "eda_event_type_lift",
    "metrics_by_rotation",
    "reconcile_top_down",
]

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    queries, sql = registry.registered(), oracle.statements()
    # what SQL cannot say: model fits
    assert set(queries) - set(sql) == {
        "fc_gbt_l1", "fc_gbt_l2", "fc_tweedie", "fc_tweedie_corrected",
        "gbt_importance", "eval_boosted", "fc_glm_tweedie", "reconcile_mint",
    }


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert len(rows) == 4 and all(r["n_obs"] > 0 for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    cursor = duck.execute(contract.oracle_sql()[name])
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want
    spark.catalog.clearCache()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["feature_matrix", "eval_all_naive", "fc_seasonal_naive", "fold_assignment"])
def test_no_cross_joins(spark, name):
    plan = physical(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_department_filter_reaches_the_part_scan(spark):
    from demandspark.operators.rollup import prepare_track
    from demandspark.sources.star_schema import daily_sales

    plan = physical(prepare_track(daily_sales(spark, SF), "fresh_weekly"))
    scans = [line for line in plan.splitlines() if "FileScan" in line and "part.parquet" in line]
    assert scans and all("FOODS_3" in line or "p_brand" in line for line in scans)
    lineitem = next(line for line in plan.splitlines() if "FileScan" in line and "l_quantity" in line)
    assert "l_extendedprice" not in lineitem


def test_evaluation_aggregates_by_hash(spark):
    from demandspark import queries

    panel = queries.fresh(spark, SF)
    _, predictions = queries.fresh_predictions(panel, queries.fresh_folds(panel))
    plan = physical(predictions)
    assert "SortAggregate" not in plan


def test_a_digest_sees_every_cell(spark):
    rows = [("A", "2020-01-01", 1, "x"), ("A", "2020-01-02", 2, None), ("A", "2020-01-03", 3, "z")]

    def digest_of(rows):
        df = spark.createDataFrame(rows, "id string, date string, sales int, flag string")
        df = df.withColumn("date", df["date"].cast("date"))
        return registry.digest(df, ["id", "date", "sales", "flag"]).first()["rows_md5"]

    plain = digest_of(rows)
    assert plain == digest_of(rows[::-1])
    for k, changed in enumerate([("A", "2020-01-01", 2, "x"), ("A", "2020-01-02", 2, "N"), ("A", "2020-01-03", None, "z")]):
        assert digest_of([changed if i == k else r for i, r in enumerate(rows)]) != plain


@pytest.mark.parametrize("name", ["id_hierarchy_item_store", "cold_start_share", "eda_christmas_totals"])
def test_sparse_facts_are_not_densified(spark, name):
    plan = contract.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Generate") <= ("calendar" in name or name == "eda_christmas_totals")


def test_department_filter_lies_below_the_joins(spark):
    plan = physical(contract.queries()["track_fresh_weekly"](spark, SF))
    joins = plan.index("Join")
    assert "FOODS_3" in plan[joins:] and "FOODS_3" not in plan[:joins]


def test_a_track_makes_no_daily_rows(spark):
    from demandspark.sources.star_schema import track_panel

    plan = physical(track_panel(spark, SF, "fresh_weekly", "part"))
    assert "interval 7 days" in plan.lower() or "INTERVAL '7' DAY" in plan.upper() or "sequence(" in plan
    assert "sequence(d0" not in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line and "part.parquet" in line]
    assert scans and all("FOODS_3" in line or "p_brand" in line for line in scans)


def test_ranks_have_no_window_over_all_series(spark):
    from demandspark.operators.segments import rotation_tiers
    from demandspark.sources.star_schema import track_panel

    plan = rotation_tiers(track_panel(spark, SF, "fresh_weekly"))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert windows and all("_before" in line or "_n" in line for line in windows)
