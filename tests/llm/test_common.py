"""Storage that survives executors, buckets, and ties."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from wattline.llm import common, jaccard_join


def session(master, folder):
    context = SimpleNamespace(master=master, applicationId="app-1")
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: folder))


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(session("spark://host:7077", None))
    assert common.shared_dir(session("spark://host:7077", "hdfs://n/x/")) == "hdfs://n/x/wattline-app-1"
    assert common.shared_dir(session("local[2]", None)).endswith("wattline-app-1")


def test_buckets_are_joined_without_an_exchange(spark):
    rows = spark.range(1000).select(F.col("id").alias("block"), F.col("id").cast("string").alias("v"))
    table, n = common.bucketed(rows, "block", 5 * common.BUCKET_BYTES, "test")
    assert n == 6
    other = spark.range(0, 1000, 3).select(F.col("id").alias("block")).repartition(n, "block")
    joined = table.join(other.hint("merge"), "block")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert joined.count() == 334


def test_rows_equal_in_id_and_text(spark):
    text = "one two three four five six"
    rows = [(1, text, "b", 2), (1, text, "a", 9), (1, text, "a", 3), (2, text, "0", 0), (3, None, "x", 1), (3, None, "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    for parts in (1, 5):
        kept = jaccard_join.keep_one(frame.repartition(parts)).collect()
        assert sorted(map(tuple, kept), key=str) == sorted([(1, text, "a", 3), (3, None, "x", 1), (3, None, "x", 1)], key=str)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.range(n).select(F.col("id").alias("a"), ((F.col("id") * 7 + 7) % (7 * n + 7)).alias("b"))
    found = common.components(edges, "a", "b").groupBy("root").count().collect()
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i in range(n):
        a, b = root(i), root((i * 7 + 7) % (7 * n + 7))
        if a != b:
            up[max(a, b)] = min(a, b)
    nodes = {i for i in range(n)} | {(i * 7 + 7) % (7 * n + 7) for i in range(n)}
    want: dict = {}
    for x in nodes:
        want[root(x)] = want.get(root(x), 0) + 1
    assert {r.root: r["count"] for r in found} == want
