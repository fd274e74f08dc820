import datetime as dt

import pytest
from plumbline.operators import graph, joins
from pyspark.sql import functions as F


def test_intervals_of_too_many_buckets_are_refused(spark):
    left = spark.createDataFrame([(dt.datetime(2000, 1, 1), dt.datetime(2020, 1, 1)), (None, dt.datetime(2020, 1, 1))], "a timestamp_ntz, b timestamp_ntz")
    right = spark.createDataFrame([(dt.datetime(2010, 1, 1),)], "t timestamp_ntz")
    assert joins.within(left, right, "a", "b", "t", 86_400).count() == 1
    with pytest.raises(Exception, match="more than 100000 buckets"):
        joins.within(left, right, "a", "b", "t", 60).collect()


def test_trees_end_at_cycles_and_depth(spark):
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("d", "c"), ("e", "d")], "src string, dst string").withColumn("rel", F.lit("subsidiary_of"))
    roots = spark.createDataFrame([("a",), ("z",)], "key string")
    found = sorted((r.root, r.node, r.depth) for r in graph.tree(edges, roots, 3).collect())
    assert found == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("z", "z", 0)]
