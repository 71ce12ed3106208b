"""Queries that once ran over a sample have a row for each order."""

import pytest

from plumbline.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["placement", "pose_in_world", "transforms_table", "result_document", "pair_document"])
def test_every_order_is_there(spark, name):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    known = orders.where("floor(o_orderkey / 2000) <> 3").count()  # session 3 has no place in the world
    want = {"placement": orders.count() + known, "pose_in_world": known}.get(name, orders.count())
    assert QUERIES[name](spark, SF).count() == want
    assert "% 25" not in ORACLES[name] and "% 50" not in ORACLES[name]
