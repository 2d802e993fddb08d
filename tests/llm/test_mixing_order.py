"""The mix comes out in shards with the planned quotas, each in an order of its own."""

from collections import Counter

from lotgrid.llm import mixing


def test_shards_hold_their_quotas_and_copies_separate(spark):
    rows = spark.createDataFrame([(i, f"w{i} " * (i % 9 + 1), f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    planned = mixing.plan_mix(rows, 8).select("doc_id", "shards").collect()
    got = mixing.mixed_shards(rows, 8).collect()
    assert Counter((r.doc_id, r._shard) for r in got) == Counter((p.doc_id, k) for p in planned for k in p.shards)
    assert [r._shard for r in got] == sorted(r._shard for r in got) and {r._shard for r in got} == set(range(8))
    out = mixing.mixed(rows, 8)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == rows.columns and ids == [r.doc_id for r in got]
    assert sum(n == 2 for n in Counter(ids).values()) > 500
    assert sum(a == b for a, b in zip(ids, ids[1:])) < 10
    rises = sum(a < b for a, b in zip(ids, ids[1:])) / len(ids)
    assert 0.45 < rises < 0.55
    assert [r.doc_id for r in mixing.mixed(rows.repartition(7, "text"), 8).collect()] == ids
