from lexiforge.runtime import join_unique


def test_hot_and_null_keys_are_joined_whole(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(900)]
    left = spark.createDataFrame(rows, "row_id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", None), ("unused", 9)], "k string, v long")
    want = sorted((i, k, {"hot": 1, "k2": 2}.get(k)) for i, k in rows)
    key = lambda r: (r[0], r[1] or "")
    for hot_rows in (10, 10_000):
        got = [tuple(r) for r in join_unique(left, right, "k", hot_rows).select("row_id", "k", "v").collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    assert join_unique(left.limit(0), right, "k").collect() == []
