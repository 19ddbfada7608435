import itertools
import random

from lexiforge.operators import dedup
from lexiforge.operators.schema import ratio

SCHEMA = "row_id long, keyword string, status string"


def frame(spark, words):
    return spark.createDataFrame([(i, w, "clash") for i, w in enumerate(words)], SCHEMA).drop("status")


def test_strategies_groups_and_status(spark):
    df = frame(spark, [None, "garden lamp", "blue tea sieve", "Blue  Tea Sieve", None, "blue tea sieve", "blue tea sieves"])
    edges, marked = dedup.detect(df)
    assert {(r.src, r.dst, r.strategy) for r in edges.collect()} == {
        ("blue tea sieve", "blue tea sieve", "exact"), ("blue tea sieve", "Blue  Tea Sieve", "normalized"), ("blue tea sieve", "blue tea sieves", "fuzzy"),
    }
    assert [r.status for r in marked.orderBy("row_id").collect()] == ["ACTIVE", "ACTIVE", "ACTIVE", "DUPLICATE", "ACTIVE", "DUPLICATE", "DUPLICATE"]
    assert {(r.metric, r.n) for r in dedup.dedup_statistics(edges, marked).collect()} >= {("rows_duplicate", 3), ("candidates_exact", 1)}


def test_fuzzy_edges_lose_no_pair(spark):
    rng = random.Random(3)
    base = ["gaming laptop for students", "curved monitor 27 inch", "garden chair", "cable"]
    words = set()
    for _ in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice("abcxyz ")], [w[k], rng.choice("abc")]])
        words.add("".join(w))
    words = sorted(words)
    got = {(r.src, r.dst): r.confidence for r in dedup.fuzzy_edges(frame(spark, words)).collect()}
    want = {(a, b) for a, b in itertools.combinations(words, 2) if a[:1].lower() == b[:1].lower() and ratio(a, b) >= 90}
    assert set(got) == want and len(want) > 50


def test_components_of_chains_stars_and_hubs(spark):
    chain = [(f"a{i:03}", f"a{i + 1:03}") for i in range(60)]
    star = [("b000", f"b{i:03}") for i in range(1, 300)]
    edges = spark.createDataFrame([(x, y, 90.0, "t") for x, y in [*chain, *star, ("c", "c")]], "src string, dst string, confidence double, strategy string")
    got = {r.node: r.label for r in dedup.components(edges).collect()}
    assert got == {**{f"a{i:03}": "a000" for i in range(61)}, **{f"b{i:03}": "b000" for i in range(300)}}


def test_empty_input(spark):
    edges, marked = dedup.detect(frame(spark, ["x"]).limit(0))
    assert edges.collect() == [] and marked.collect() == []


def test_tiles_lose_no_pair(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([9, 10, 11, 20]))) for _ in range(120)} | {"a" * 70 + "".join(rng.choice("xyé") for _ in range(9)) for _ in range(12)})
    want = {(a, b) for a, b in itertools.combinations(words, 2) if a[0] == b[0] and ratio(a, b) >= 90}
    monkeypatch.setattr(dedup, "TILE", 20)
    got = [(r.src, r.dst) for r in dedup.fuzzy_edges(frame(spark, words)).collect()]
    assert set(got) == want and len(got) == len(want) > 50


def test_queries_cover_the_whole_keyword_table(spark):
    from lexiforge import queries

    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/demo_keywords.parquet")
    rows = [r.keyword for r in table.collect()]
    marked = queries.keyword_status(spark, d).collect()
    assert sorted(r.row_id for r in marked) == sorted(r.row_id for r in table.collect())
    words = sorted({w for w in rows if w})
    near = lambda a, b: a[0].lower() == b[0].lower() and 2 * min(len(a), len(b)) >= 0.9 * (len(a) + len(b)) and ratio(a, b) >= 90
    want = {(a, b) for a, b in itertools.combinations(words, 2) if near(a, b)}
    assert {(r.src, r.dst) for r in queries.keyword_fuzzy_edges(spark, d).collect()} == want and want


def test_no_table_of_strings_is_broadcast(spark, tmp_path, monkeypatch):
    """The stored table is so small that the planner would broadcast it and all that is made of it."""
    words = ["Green Hat", "green  hat", "green hats", "blue coat of wool", "blue coat of wools", "red shoe"]
    frame(spark, [words[i % 6] + " x" * (i // 6) for i in range(60)]).coalesce(1).write.parquet(f"{tmp_path}/kw")
    df = spark.read.parquet(f"{tmp_path}/kw")
    plans = []
    seen = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or cut(d)
    cut = dedup.cut
    monkeypatch.setattr(dedup, "cut", seen)
    edges, marked = dedup.detect(df)
    plans += [d._jdf.queryExecution().executedPlan().toString() for d in (marked, dedup.groups(edges))]
    assert sum("SortMergeJoin" in p for p in plans) >= 5
    assert [p for p in plans if "BroadcastExchange" in p and "FlatMapGroupsInPandas" not in p] == []  # the tiles' blocks are few
    assert {r.row_id: r.status for r in marked.filter("row_id < 6").collect()} == {0: "ACTIVE", 1: "DUPLICATE", 2: "DUPLICATE", 3: "ACTIVE", 4: "DUPLICATE", 5: "ACTIVE"}


def test_groups_are_found_once(spark, monkeypatch):
    from lexiforge import queries

    calls = []
    components = dedup.components
    monkeypatch.setattr(dedup, "components", lambda e: calls.append(1) or components(e))
    assert queries.dedup_groups(spark, "/root/testdata/sf0.001").count() >= 0 and len(calls) == 1


def test_the_reckoned_size_stays_short_over_the_rounds(spark, monkeypatch):
    """Joins multiply the sizes of their sides; carried from round to round, the number filled the driver's heap."""
    edges = spark.createDataFrame([(f"a{i:03}", f"a{i + 1:03}", 90.0, "t") for i in range(200)], "src string, dst string, confidence double, strategy string")
    sizes = []
    cut = dedup.cut
    size = lambda d: d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    monkeypatch.setattr(dedup, "cut", lambda d: sizes.append(size(o := cut(d))) or o)
    labels = dedup.components(edges)
    assert {r.label for r in labels.collect()} == {"a000"} and len(sizes) > 5
    assert max(sizes) < 1_000


def test_the_rounds_run_over_numbers(spark, monkeypatch):
    """Tables of strings, written in every round, filled the disk and the driver with them; only the names are written once."""
    names = ["b", "B", "é", "ab", "a b", "zz", "😀", "", "c"]
    edges = spark.createDataFrame([(a, b, 90.0, "t") for a, b in [("b", "B"), ("é", "B"), ("zz", "ab"), ("a b", "zz"), ("😀", ""), ("c", "c")]], "src string, dst string, confidence double, strategy string")
    kinds = []
    cut = dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda d: kinds.append([t for _, t in d.dtypes]) or cut(d))
    labels = {r.node: r.label for r in dedup.components(edges).collect()}
    assert labels == {"b": "B", "B": "B", "é": "B", "zz": "a b", "ab": "a b", "a b": "a b", "😀": "", "": ""} and set(labels) < set(names)
    assert len(kinds) > 3 and sum("string" in k for k in kinds) == 1
