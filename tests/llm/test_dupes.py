import random
from collections import defaultdict

from lexiforge.llm import dupes

DEMO = "row_id long, upload_id long, keyword string, search_volume long, language string, country string, key string, hash string"
ROWS = "row_id long, upload_id long, keyword string, volume long, attrs string"


def records(spark, demo, rows):
    return dupes.keyword_records(spark.createDataFrame(demo, DEMO), spark.createDataFrame(rows, ROWS))


def test_writings_collapse(spark):
    demo = [
        (1, 1, "Gaming Laptop", 5, "en", None, "", ""), (2, 1, " gaming-LAPTOP!", 5, "en", None, "", ""), (3, 1, "gaming laptop", 6, "en", None, "", ""), (4, 2, "gaming laptop", 5, "en", None, "", ""),
        (5, 1, None, 5, "en", None, "", ""), (6, 1, None, 5, "en", None, "", ""), (7, 1, "…", 5, "en", None, "", ""), (8, 1, "", 5, "en", None, "", ""), (9, 1, "STRASSE", None, None, None, "", ""), (10, 1, "straße", None, None, None, "", ""),
    ]
    rows = [(1, 1, "kw", 5, "a=1; b = X"), (2, 1, "K.W", 5, "B=x;a=1;"), (3, 1, "kw", 5, None), (4, 1, "kw", 5, None), (5, 1, "kw", 5, "a=1")]
    got = {(r.src, r.keep_id, r.dup_id) for r in dupes.copies(records(spark, demo, rows)).collect()}
    assert got == {("demo_keywords", 1, 2), ("demo_keywords", 7, 8), ("demo_keywords", 9, 10), ("duplicate_rows", 1, 2), ("duplicate_rows", 3, 4)}
    one = {(r.src, r.row_id): r.n_copies for r in dupes.collapsed(records(spark, demo, rows)).collect()}
    assert one[("demo_keywords", 1)] == 2 and one[("demo_keywords", 5)] == 1 and one[("demo_keywords", 6)] == 1 and sum(one.values()) == 15


def test_hot_key_many_partitions_and_passes(spark, monkeypatch):
    monkeypatch.setattr(dupes, "HOT_COPIES", 100)
    rng = random.Random(5)
    words = ["hot"] * 700 + [f"w{rng.randint(0, 900)}" for _ in range(1400)]
    rng.shuffle(words)
    df = spark.createDataFrame([(i, 1, w.upper() if i % 2 else w, 1, None) for i, w in enumerate(words)], ROWS)
    demo = spark.createDataFrame([], DEMO)
    recs = dupes.keyword_records(demo, df).repartition(7)
    groups = defaultdict(list)
    for i, w in enumerate(words):
        groups[w].append(i)
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {(r.keep_id, r.dup_id) for r in dupes.copies(recs).collect()} == want
    flagged = dupes.flag_possible_repeats(recs, n_keys=200_000, max_filter_bytes=1 << 17).select("row_id", "maybe").collect()
    assert len(flagged) == len(words) and {i for g in groups.values() if len(g) > 1 for i in g} <= {r.row_id for r in flagged if r.maybe}
    assert sum(not r.maybe for r in flagged) > 0.9 * sum(len(g) == 1 for g in groups.values())


def test_filters_of_many_partitions_are_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(dupes, "MERGED_AT_ONCE", 3)
    df = spark.createDataFrame([(i, 1, f"w{i % 150}", 1, None) for i in range(200)], ROWS)
    recs = dupes.keyword_records(spark.createDataFrame([], DEMO), df.repartition(11, "row_id"))
    assert {(r.keep_id, r.dup_id) for r in dupes.copies(recs).collect()} == {(i, i + 150) for i in range(50)}


def test_more_passes_let_no_more_singletons_through(spark):
    df = spark.createDataFrame([(i, 1, f"w{i}", 1, None) for i in range(30_000)], ROWS)
    recs = dupes.keyword_records(spark.createDataFrame([], DEMO), df)
    rate = lambda **size: dupes.flag_possible_repeats(recs, **size).filter("maybe").count() / 30_000
    assert rate() < 0.03 and rate(max_filter_bytes=1 << 12, n_keys=30_000) < 0.03
    assert rate(n_keys=500_000, max_filter_bytes=1 << 16) < 0.03


def test_empty_tables(spark):
    empty = records(spark, [], [])
    assert dupes.copies(empty).collect() == [] and dupes.collapsed(empty).collect() == []
