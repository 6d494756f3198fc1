"""Stored (bucketed) business tables give the oracle's results, and the graph sink round-trips."""

import os

import pytest

from stockroom.operators import network
from stockroom.plans.catalog import REGISTRY
from stockroom.sources.derived import Tables
from stockroom.sources.store import Store
from tests.conftest import SF_SMALL
from tests.oracle_harness import _rows, duck, duck_rows, spark_rows


@pytest.fixture(scope="module")
def store(spark):
    import tempfile
    return Store.materialize(Tables(spark, SF_SMALL), tempfile.mkdtemp(prefix="stockroom-store-"),
                             buckets=4, prefix="teststore")


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", sorted(REGISTRY))
def test_stored_matches_oracle(store, con, key):
    got = _rows(*spark_rows(REGISTRY[key].build(store)))
    want = _rows(*duck_rows(con, REGISTRY[key].sql))
    assert got == want


def _final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_bucketed_aggregate_and_join_do_not_shuffle(spark, store):
    """groupBy(sku) and the sku join read co-located buckets: no hash exchange."""
    from stockroom.operators import demand
    assert "Exchange" not in _final_plan(demand.demand_stats(store.sales))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # force the big-table path
    try:
        plan = _final_plan(network.product_orders(store.purchase_orders, store.inventory))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "hashpartitioning" not in plan


def test_graph_sink_round_trip(spark, store, workdir):
    path = os.path.join(workdir, "graph")
    network.write_graph(store.supplier, store.inventory, store.purchase_orders, path)
    nodes = spark.read.parquet(os.path.join(path, "nodes"))
    edges = spark.read.parquet(os.path.join(path, "edges"))
    assert nodes.count() == network.graph_nodes(store.supplier, store.inventory,
                                                store.purchase_orders).count()
    assert {r["rel"] for r in edges.select("rel").distinct().collect()} == \
        {"SUPPLIES", "ORDERS", "FROM_SUPPLIER"}


class _HotSales(Tables):
    """Sales where one sku holds half of all rows."""

    @property
    def sales(self):
        from pyspark.sql import functions as F
        base = Tables(self.spark, self.sf_dir).sales
        return base.unionByName(base.withColumn("sku", F.lit("SKU-HOT")))


def test_hot_key_is_not_bucketed(spark, workdir):
    from stockroom.operators import demand
    hot = _HotSales(spark, SF_SMALL)
    st = Store.materialize(hot, os.path.join(workdir, "hot"), buckets=8, prefix="hotstore")
    assert st.layout["sales_data"] == "plain"
    assert st.layout["inventory_data"].startswith("bucketed")
    want = demand.demand_stats(hot.sales)
    got = demand.demand_stats(st.sales)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_default_store_path_is_under_the_shared_folder(spark):
    from stockroom.session import shared_dir
    st = Store.materialize(Tables(spark, SF_SMALL), buckets=2, prefix="defaultpath")
    assert st.path.startswith(shared_dir(spark))
    assert st.sales.count() == Tables(spark, SF_SMALL).sales.count()
