import json
import random

from lexiforge.operators import drift

FILES = "file_id long, feed_id long, file_name string, period string, received_at string, n_rows long"


def tables(spark, feeds):
    """feeds: {feed: [[record, ...] of each file]}"""
    files, rows, fid = [], [], 0
    for feed, versions in feeds.items():
        for k, records in enumerate(versions):
            fid += 1
            files.append((fid, feed, "f", f"2024-01-{k + 1:02}", f"2024-02-{28 - k:02}", len(records)))
            rows += [(fid, n, r if r is None or isinstance(r, str) else json.dumps(r)) for n, r in enumerate(records)]
    f = spark.createDataFrame(files, FILES)
    return f, spark.createDataFrame(rows, "file_id long, line_no long, payload string")


def changes(spark, feeds):
    f, r = tables(spark, feeds)
    return {(x.file_id, x.change, x.old_field, x.new_field) for x in drift.schema_changes(f, r).collect()}, r


def test_every_kind_of_change(spark):
    got, _ = changes(spark, {
        1: [[{"Keyword": "a", "SV": 5, "cpc": 1.5}], [{"keyword": "a", "SV": "5", "Country": "US"}], [{"keyword": "a", "SV": 5, "Country": ["US"]}, {"SV": 2.0}]],
        2: [[{"x": None, "flag": True}], [{"x": 1, "flag": 1}]],
    })
    assert got == {
        (2, "renamed", "Keyword", "keyword"), (2, "retyped", "SV", "SV"), (2, "removed", "cpc", ""), (2, "added", "", "Country"),
        (3, "retyped", "SV", "SV"), (3, "retyped", "Country", "Country"), (5, "retyped", "flag", "flag"),
    }


def test_a_whole_number_written_as_decimal_is_decimal(spark):
    got, _ = changes(spark, {1: [[{"cpc": 5}], ['{"cpc": 5.0}'], ['{"cpc": 12345678901234567890}'], [{"cpc": 7}]]})
    assert got == {(2, "retyped", "cpc", "cpc"), (3, "retyped", "cpc", "cpc")}


def test_unknown_names_are_matched_by_their_values(spark):
    rng = random.Random(2)
    first = [{"keyword": f"k{i}", "zeta": rng.choice(["red", "blue"]), "eta": rng.randint(0, 9)} for i in range(40)]
    second = [{"keyword": f"k{i}", "colour": rng.choice(["red", "blue"]), "size": rng.randint(10**6, 10**7)} for i in range(40)]
    got, _ = changes(spark, {1: [first, second]})
    assert (2, "renamed", "zeta", "colour") in got and (2, "removed", "eta", "") in got and (2, "added", "", "size") in got


def test_faulty_payloads_empty_files_and_empty_tables(spark):
    got, rows = changes(spark, {1: [["no json", None, "[1]", {"a": 1}], [], [{"a": 1}]]})
    assert got == {(2, "removed", "a", ""), (3, "added", "", "a")}
    told = {r.line_no: (r.problem, r.unread) for r in drift.unified(rows.filter("file_id = 1")).collect()}
    assert sorted(told.values(), key=str) == [("not_json", "no json"), ("not_object", "[1]"), ("null", None), (None, None)]
    odd = rows.limit(1).selectExpr("file_id", "line_no", "'{}' as payload")
    assert [r.problem for r in drift.unified(odd).collect()] == ["empty"]


def test_no_record_is_lost_and_nothing_is_shuffled(spark):
    _, rows = changes(spark, {1: [[{"kw": "a", "Keyword": "b", "x": 1}, {}, None, "7"]]})
    got = drift.unified(rows)
    assert got.count() == rows.count() == 4 and "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    first = got.filter("problem is null").first()
    assert first.keyword == "b" and json.loads(first.others) == {"kw": "a", "x": "1"}


def test_no_table_of_names_is_needed_for_like_values(spark):
    rng = random.Random(4)
    make = lambda kw, vol: [{kw: rng.choice("abcdefgh") * 9, vol: rng.randint(1, 40)} for _ in range(60)]
    files, rows = tables(spark, {1: [make("keyword", "sv"), make("suchwort", "menge")]})
    got = {tuple(r)[1:] for r in drift.schema_changes(files, rows, {"none": ()}).collect()}
    assert got == {("renamed", "keyword", "suchwort"), ("renamed", "sv", "menge")}


def test_empty_tables(spark):
    none, empty = changes(spark, {1: [[{"a": 1}]]})
    assert none == set() and drift.unified(empty.limit(0)).collect() == []


def test_one_table_of_one_schema(spark):
    _, rows = changes(spark, {1: [[{"SV": "70,582", "Keyword": " a ", "tags": "b, a", "Competition": 0.87, "is_branded": "Y", "last_seen": 20240301, "odd": 3}],
                                  [{"volume": 12, "kw": "b", "labels": ["b", "a"], "comp": "HIGH", "branded": 1, "seen_on": "2024-03-01"}]]})
    a, b = drift.unified(rows).orderBy("file_id").collect()
    assert (a.search_volume, b.search_volume) == (70582, 12) and (a.search_volume_branch, b.search_volume_branch) == ("string", "whole")
    assert a.tags == b.tags == "a,b" and a.competition == b.competition == "HIGH" and a.branded and b.branded
    assert a.seen_on == b.seen_on and a.keyword == "a" and "odd" in a.others and b.others is None
