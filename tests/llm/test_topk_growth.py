"""What the exact top-k holds where does not grow with queries times rows."""

from inkstream.llm import topk


def test_queries_are_dealt_to_shards_and_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_SHARD", 64)
    rows = [(i, [(i * 7 % 11) / 8, (i * 5 % 13) / 8, (i % 3) / 8]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.exact_top_k(df, df.vec_id % 50 == 0, 5)
    assert found.count() == 8 * 5
    query = found.groupBy("query_id").count()
    query.collect()
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan
