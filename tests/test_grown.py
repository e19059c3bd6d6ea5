"""Tables that outgrow the sketches' parameters: the same rows as SQL."""

import duckdb
import pytest

from cellmesh.plans import catalog

from .test_catalog import normal

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
TABLES = {
    # Some 14,000 users, few of them busy.
    "events": (60_000, "id AS event_id", "cast(if(id % 4 = 0, sqrt(id % 400), pmod(xxhash64(id), 14000)) as bigint) AS user_id", "element_at(array('click', 'view', 'error'), cast(id % 3 + 1 as int)) AS event_type", "(id % 997 + 1) / 10D AS value"),
    "supplier": (9_000, "id AS s_suppkey", "pmod(xxhash64(id), 700000) / 100D AS s_acctbal"),
    "lineitem": (200_000, "id AS l_orderkey", "cast(id % 7 + 1 as int) AS l_linenumber", "pmod(xxhash64(id), 9000) / 4D AS l_extendedprice"),
}


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("grown"))
    for name, (n, *columns) in TABLES.items():
        spark.range(0, n, 1, 3).selectExpr(*columns).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.fixture(scope="module")
def duck(grown):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{grown}/{name}.parquet/*.parquet'")
    return con


def check(spark, duck, grown, name):
    df = QUERIES[name](spark, grown)
    expected = duck.sql(SQL[name])
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(expected.fetchall(), expected.columns)


def test_top_k_of_more_users_than_are_tracked(spark, duck, grown):
    check(spark, duck, grown, "approx_top_k_builtin")


def test_histogram_of_a_full_sketch(spark, duck, grown):
    check(spark, duck, grown, "hll_histogram")


def test_linear_counting_of_many_registers(spark, duck, grown):
    check(spark, duck, grown, "hll_sparse")


@pytest.mark.parametrize("name", ["kll_cdf_exact_small", "kll_quantile", "kll_quantile_li", "kll_rank", "kll_share", "kll_share_linear"])
def test_exact_sketches_of_many_values(spark, duck, grown, name):
    check(spark, duck, grown, name)


def test_space_saving_of_every_key(spark, duck, grown):
    check(spark, duck, grown, "space_saving_all_tracked")


def test_frames_of_every_key(spark, duck, grown):
    check(spark, duck, grown, "array_heap_keys")


def test_messages_of_every_key(spark, duck, grown):
    check(spark, duck, grown, "portable_cs_delta_keys")


@pytest.mark.parametrize("name", ["univmon_cardinality", "univmon_entropy", "univmon_merge"])
def test_pyramids_of_every_key(spark, duck, grown, name):
    check(spark, duck, grown, name)


def test_hybrids_of_many_users(spark, duck, grown):
    check(spark, duck, grown, "eh_hybrid")


def test_exact_quantiles_without_one_task(spark, duck, grown):
    check(spark, duck, grown, "dd_rel_error")
    assert "percentile" not in QUERIES["dd_rel_error"](spark, grown)._jdf.queryExecution().optimizedPlan().toString()


def test_labels_are_summed_before_they_are_expanded(spark):
    from .conftest import SF

    plan = lambda name: QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan("multihead_mixed")
    assert "_cells" in plan("multihead_query")
    assert "_labels" in plan("hydra_cdf") and "_labels" in plan("hydra_kll")
