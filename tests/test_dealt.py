"""Rows dealt by a key: a task's share does not grow with the files, and what follows deals them no second time."""

import re

import pytest

from inkstream import registry
from inkstream.operators import books
from inkstream.sources.tables import PARTS, dealt


def test_f12_f13_f14_f15_parts_grow_with_the_files(spark):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for splits in (1, 10, 50):
        rows = spark.range(0, 100, 1, splits)
        assert dealt(rows, "id").rdd.getNumPartitions() == max(least, PARTS * splits)


#: Of merging, notes meet the chapters of their own key; of the catalogue, chapters are dealt again to meet the pickups.
@pytest.mark.parametrize("name, more", [("project_merge", 2), ("merge_sentence", 2), ("catalogue_violations", 1), ("seat_segments", 0)])
def test_f12_f13_f14_f15_every_exchange_by_the_large_keys_is_dealt(spark, small, name, more):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    large = re.findall(r"Exchange hashpartitioning\((?:id|chapter_id|l_orderkey|o_orderkey|place)#.*", plan)
    assert large and sum("REPARTITION_BY_NUM" not in x for x in large) <= more


def test_f14_repeated_keys_of_several_columns(spark):
    rows = spark.createDataFrame([(1, 2), (1, 2), (1, None), (None, 1), (3, 3)], "a int, b int")
    assert [tuple(r) for r in books.repeated_keys(rows, "t", "a", "b").collect()] == [("t", "1:2", "unique")]
    assert [tuple(r) for r in books.repeated_keys(rows, "t", "b").collect()] == [("t", "2", "unique")]
