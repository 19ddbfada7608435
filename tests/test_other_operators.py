import io

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import analytics, lookup, match, profile, schema
from lexiforge.sources import files, sinks


def test_header_resolution():
    assert schema.resolve_keyword_column(["Volume", "Search Query", "keyword"])[0] == ("keyword", "EXACT", 100.0)
    assert schema.resolve_keyword_column(["search querys"]) == [("search querys", "FUZZY", 96.3)] or schema.resolve_keyword_column(["search querys"])[0][1] == "FUZZY"
    with pytest.raises(schema.SchemaError):
        schema.resolve_keyword_column(["price"])


def test_projection_and_clashing_headers(spark):
    df = spark.createDataFrame([("k", "1", "x", "y")], "`Search Keyword ` string, SV string, Noise string, `noise ` string")
    out, left = schema.project_canonical(df)
    assert out.columns == ["keyword", "volume"] and left == ["noise", "noise#2"]
    with pytest.raises(schema.SchemaError):
        schema.project_canonical(df.select("SV"))


def test_csv_and_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"\nc", "1"), ("NA", None), ("x", "2")], "keyword string, volume string")
    sinks.write_workbook({"Data": df, "Copy": df.limit(1)}, str(tmp_path / "w.xlsx"))
    assert files.sheet_names(str(tmp_path / "w.xlsx")) == ["Data", "Copy"]
    back = files.load(spark, str(tmp_path / "w.xlsx")).collect()
    assert [tuple(r) for r in back] == [("a,\"b\"\nc", "1"), (None, None), ("x", "2")]
    (tmp_path / "k.csv").write_text('keyword,volume\n"a,""b""\nc",1\nNA,\nx,2\n', encoding="utf-8")
    assert [tuple(r) for r in files.load(spark, str(tmp_path / "k.csv")).collect()] == [("a,\"b\"\nc", "1"), (None, None), ("x", "2")]
    assert files.load(spark, b"keyword\ncaf\xe9\n", "u.csv").first()[0] == "café"
    for bad in ("u.txt", "empty.csv"):
        (tmp_path / bad).write_bytes(b"")
        with pytest.raises(files.InputError):
            files.load(spark, str(tmp_path / bad))
    with pytest.raises(files.InputError):
        files.read_workbook(spark, str(tmp_path / "w.xlsx"), "None")


def test_entities_of_many_words_match(spark):
    long = "one two three four five six seven eight"
    kw = spark.createDataFrame([(1, f"buy {long} now"), (2, "one two three"), (3, None)], "row_id long, keyword string")
    ent = spark.createDataFrame([("category", 1, long.title()), ("brand", 2, "Two"), ("brand", 3, "!")], "kind string, ord int, entity string")
    assert {(r.row_id, r.entity) for r in match.contained(kw, ent).collect()} == {(1, long.title()), (1, "Two"), (2, "Two")}
    assert match.contained(kw, ent.limit(0)).collect() == []


def test_matching_is_by_words_and_in_order(spark):
    kw = spark.createDataFrame([(1, "best ThinkPad for business"), (2, "thinkpads"), (3, None), (4, "lenovo vs apple laptop")], "row_id long, keyword string")
    ent = spark.createDataFrame([("brand", 2, "Apple"), ("brand", 1, "Lenovo"), ("category", 1, "Laptop"), ("family", 1, "ThinkPad"), ("brand", 3, "!")], "kind string, ord long, entity string")
    found = match.contained(kw, ent)
    assert {(r.row_id, r.kind, r.entity) for r in match.first_match(found).collect()} == {(1, "family", "ThinkPad"), (4, "brand", "Lenovo"), (4, "category", "Laptop")}
    assert {r.entities for r in match.all_matches(found).filter("kind = 'brand'").collect()} == {"Lenovo|Apple"}
    assert match.profile_context(found).filter("row_id = 4").first().reason == "Comparison query"


def test_resolvers_rule_engine_and_cascade(spark):
    kw = spark.createDataFrame([(1, "acme lamp pro usb c"), (2, "lamp"), (3, "acme vs bolt"), (4, None), (5, "superacmeshop"), (6, "nothing")], "row_id long, keyword string")
    ent = spark.createDataFrame(
        [("brand", 1, "Acme", None, 3.0), ("brand", 2, "Bolt", None, 0.0), ("category", 1, "Lamp", None, 2.0), ("family", 1, "Lamp Pro", "Lamps", 0.0),
         ("product", 1, "acme lamp", None, 0.0), ("technology", 1, "USB-C", None, 0.0), ("company", 10**7, "Acme", None, 0.0), ("segment", 1, "!", None, 0.0)],
        "kind string, ord long, entity string, parent string, evidence double",
    )
    got = {(r.row_id, r.kind): (r.entity, r.parent, r.score) for r in match.resolve(kw, ent.filter("kind <> 'company'")).collect()}
    assert got[1, "product"] == ("acme lamp", "Unknown", 1.0) and got[1, "family"][1] == "Lamps" and got[2, "category"][2] == 0.92 and got[1, "technology"][0] == "USB-C"
    told = {r.row_id: r for r in match.rule_context(kw, ent.filter("kind <> 'company'"), "bolt").collect()}
    assert told[3].reason == "Comparison query" and told[3].brand == "Bolt" and told[3].needs_review and told[4].reason == told[6].reason == "No match"
    assert told[1].reason.startswith("Matched family 'Lamp Pro' and product 'acme lamp' and brand 'Acme'") and told[1].confidence == 1.0
    levels = {r.row_id: (r.level, r.relevance, r.confidence) for r in match.cascade(kw, ent).collect()}
    assert levels == {1: (1, "RELEVANT", 99.0), 2: (5, "RELEVANT", 70.0), 3: (1, "RELEVANT", 99.0), 4: (None, "UNCERTAIN", 0.0), 5: (1, "RELEVANT", 99.0), 6: (None, "UNCERTAIN", 0.0)}
    counts = {r.kind: (r.matches, r.misses) for r in match.match_counts(kw, match.contained(kw, ent.filter("kind = 'brand'")), ("brand", "service")).collect()}
    assert counts == {"brand": (2, 4), "service": (0, 6)}
    assert match.cascade(kw.limit(0), ent.limit(0)).collect() == []


def _stored(spark, tmp_path):
    """Keywords and more entities than are broadcast, in files so small that the planner would broadcast anything made of them."""
    spark.range(20).selectExpr("id as row_id", "concat('acme item', id, ' pro') as keyword").write.parquet(f"{tmp_path}/kw")
    kind = "case when id = 0 then 'company' when id % 2 = 0 then 'brand' else 'product' end as kind"
    spark.range(3000).selectExpr(kind, "id as ord", "concat('item', id) as entity", "'p' as parent", "1.0d as evidence").write.parquet(f"{tmp_path}/ent")
    return spark.read.parquet(f"{tmp_path}/kw"), spark.read.parquet(f"{tmp_path}/ent")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_resolve_broadcasts_no_side_that_grows(spark, tmp_path):
    kw, ent = _stored(spark, tmp_path)
    found = match.resolve(kw, ent.filter("kind <> 'company'"))
    assert "BroadcastExchange" not in _plan(found)
    assert {(r.row_id, r.kind, r.entity) for r in found.collect()} == {(i, "brand" if i % 2 == 0 else "product", f"item{i}") for i in range(1, 20)}


def test_rule_context_broadcasts_no_side_that_grows(spark, tmp_path):
    kw, ent = _stored(spark, tmp_path)
    told = match.rule_context(kw, ent.filter("kind <> 'company'"), "item4")
    assert _plan(told).count("BroadcastExchange") <= 1  # the few brands
    assert {r.row_id: r.brand for r in told.collect()} == {i: (f"item{i}" if i % 2 == 0 else "item4") if i else None for i in range(20)}


def test_cascade_broadcasts_no_side_that_grows(spark, tmp_path):
    kw, ent = _stored(spark, tmp_path)
    found = match.cascade(kw, ent.withColumn("evidence", F.when(F.col("ord") == 2, 3.0)))
    assert _plan(found).count("BroadcastExchange") <= 1  # the levels
    got = {r.row_id: (r.level, r.entity, r.confidence) for r in found.collect()}
    assert got[0] == (1, "item0", 99.0) and got[2] == (3, "item2", 85.0) and got[3] == (4, "item3", 65.0) and len(got) == 20


def test_the_exact_median_is_found_in_ranges(spark):
    import random
    import statistics

    rng = random.Random(2)
    for n in (0, 1, 2, 7, 500):
        values = [rng.choice([rng.gauss(0, 1e6), 5.0, 1e-9]) for _ in range(n)] + [None, float("nan")]
        df = spark.createDataFrame([(v,) for v in values], "v double")
        want = statistics.median(values[:n]) if n else None
        assert analytics.middle(df, "v", 7).first()[0] == want


def test_distributions_and_accounts(spark):
    df = spark.createDataFrame([(1, 0.95, True, False), (2, 0.6, False, None), (3, None, None, True), (4, float("nan"), True, True)], "row_id long, c double, keep boolean, ask boolean")
    assert tuple(analytics.relevance_distribution(df, F.col("keep"), F.col("ask")).first()) == (1, 1, 2)
    assert tuple(analytics.quality_distribution(df, "c").first()) == (1, 0, 1, 0, 2)
    assert tuple(analytics.accounting(df, {"a": F.col("keep"), "b": ~F.coalesce("keep", F.lit(False))}).first()) == (4, 2, 2, True)
    assert not analytics.accounting(df, {"a": F.col("keep"), "b": F.col("ask")}).first().balanced
    assert {r.metric: r.n for r in analytics.key_figures(df, "row_id", {"asked": F.col("ask")}).collect()} == {"rows": 4, "distinct_row_id": 4, "asked": 2}
    assert analytics.health(0) == "HEALTHY" and analytics.health(2) == "DEGRADED"


def test_pages_to_entities(spark):
    html = """<nav><ul><li><a href="/a">Laptops</a></li></ul></nav><h1>Legion <b>5</b></h1><h2>Gaming</h2><a href="/x/">x</a>
    <script type="application/ld+json">{"@type":"Product","name":"Legion 5","brand":{"name":"Lenovo"}}</script><script type="application/ld+json">bad</script>"""
    pages = spark.createDataFrame([(1, "https://www.shop.example/laptops/legion-5", html), (2, "https://www.shop.example/", None)], "page_id long, source_url string, html string")
    found = profile.mentions(pages)
    ev = {r.entity: (r.entity_type, r.sources) for r in profile.evidence(found).collect()}
    assert ev["Laptops"] == ("Category", "NAVIGATION,URL") and ev["Legion 5"][0] == "Product" and ev["Lenovo"] == ("Brand", "SCHEMA")
    assert ("Legion 5", "Laptops") in {(r.child, r.parent) for r in profile.relations(found).collect()}
    names = spark.createDataFrame([(1, "Laptop / Notebook"), (2, "Docking Station (DS)"), (3, "Home"), (4, "Mac Studio Pro"), (5, "Mac Studio Max")], "ord long, entity string")
    assert {(r.term, r.synonym) for r in profile.synonyms(names).collect()} == {("laptop", "Notebook"), ("notebook", "Laptop")}
    assert [tuple(r) for r in profile.aliases(names).collect()] == [("DS", "Docking Station")]
    assert "Home" not in {r.entity for r in profile.split_entities(names).collect()}


def test_lookups(spark):
    kw = spark.createDataFrame([(i, f"k{i % 1500}") for i in range(3000)], "row_id long, keyword string")
    vol = {r.keyword: r for r in lookup.mock_volume(kw).collect()}
    import hashlib

    h = int(hashlib.md5(b"k7").hexdigest(), 16)
    assert vol["k7"].search_volume == 10 + h % 499990 and vol["k7"].cpc == round(0.05 + (h % 4995) / 100, 2)
    sizes = sorted(r["count"] for r in lookup.batches(kw, 2000, 1000).groupBy("batch_no").count().collect())
    assert sizes == [500, 1000]

    def provider(keys):
        if "k3" in keys:
            raise RuntimeError("quota exceeded")
        return [{"keyword": k, "volume": len(k)} for k in keys]

    out = lookup.run_batches(kw.filter("row_id < 10").coalesce(1), provider, "keyword string, volume long", size=5).collect()
    assert sum(r.error is not None for r in out) == 5 and sum(r.volume == 2 for r in out) == 5


def test_json_repair(spark):
    texts = ['[{"keyword":"a"}]', '```json\n{"keywords":[{"keyword":"a"}]}\n```', '{"keyword":"a"}\n{"keyword":"b"}', 'Sure! {"keyword":"a {"} and {"keyword":"b"}', '{"keyword":["a","b"],"relevance":["X","Y"]}', '{"a":{"relevance":"X"}}', "nothing", None]
    assert [len(lookup.repair_json(t)) for t in texts] == [1, 1, 2, 2, 2, 1, 0, 0]
    df = spark.createDataFrame(list(enumerate(texts)), "answer_id long, answer string")
    assert lookup.parse_answers(df).count() == 9


def test_analytics_on_odd_values(spark):
    df = spark.createDataFrame([(1, "a", "5", 0.5), (2, "b", "x", float("nan")), (3, None, None, None), (4, "a", "7", 2.0)], "row_id long, keyword string, volume string, confidence double")
    s = analytics.number_stats(df, "volume").first()
    assert (s.mean, s.median, s.n_valid, s.n_missing) == (6.0, 6.0, 2, 2)
    assert [r.row_id for r in analytics.top_rows(df, "volume").collect()] == [4, 1]
    assert {r.gate: r.passed for r in analytics.quality_gates(df, "confidence", ("keyword",)).collect()} == {"has_rows": True, "confidence_in_range": False, "required_columns": True}
    assert analytics.dominant(df, "keyword", ("b", "a")).first().value == "a" and analytics.dominant(df.limit(0), "keyword", ("b", "a")).first().value == ""
    assert io is not None
