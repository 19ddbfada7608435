"""Schemas that drift between files: tagged-union inference, one unified table, and a list of all changes.

Every record is opened as a VARIANT in the JVM. The schemas of all files are fused in parallel: for each path the alternative
types stay side by side, with their counts (a tagged union). A conflict between alternatives is split into a branch tag and
a conversion to one canonical type, so a field that was a number in one file and text in another is one column.
Alternatives that appear, vanish or change name between a file and the one before it in its feed are reported.

Field names are matched by a table of known names (a parameter); names it doesn't hold are matched by profiles of their
values. All statistics are map-side aggregates on (file, field); a file with a third of all rows stays spread. The fields of a file are
then one row, so files are compared pair by pair.

Records that aren't JSON objects and null payloads have no fields; the unified table has them all the same, with the problem and the
payload. Null values count for the presence of a field, not for its kind. A file without records has no fields. Ties of the period are ordered by arrival, then by file_id. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.runtime import cut

#: Names under which exports carry each quantity (lower case, words separated by one blank).
KNOWN_NAMES = {
    "keyword": ("keyword", "search keyword", "search term", "kw", "query"),
    "search_volume": ("search volume", "volume", "sv", "vol", "monthly volume", "avg monthly searches", "monthly searches"),
    "cpc": ("cpc", "cost per click", "click price"),
    "competition": ("competition", "comp", "competition level"),
    "difficulty": ("keyword difficulty", "difficulty", "kd", "rank effort"),
    "intent": ("intent", "search intent", "user goal"),
    "country": ("country", "location", "loc", "market", "region"),
    "tags": ("tags", "labels"),
    "branded": ("branded", "is branded"),
    "position": ("position", "serp rank", "serp position"),
    "source": ("source", "src", "origin"),
    "seen_on": ("seen on", "last seen", "date"),
}
KINDS = ("string", "whole", "decimal", "boolean", "list", "object")
PROFILE_MATCH = 0.8


def name_key(c: Column) -> Column:
    spaced = F.regexp_replace(c, r"(?<=[a-z])(?=[A-Z])", " ")
    return F.trim(F.regexp_replace(F.lower(spaced), r"[^\p{L}\p{N}]+", " "))


def quantity(c: Column, names: dict = KNOWN_NAMES) -> Column:
    """The quantity a field name stands for; unknown names stand for themselves, whatever their case."""
    pairs = {n: q for q, ns in names.items() for n in (*ns, q.replace("_", " "))}
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, name_key(c)), F.concat(F.lit("?"), name_key(c)))


def kind_of(t: Column) -> Column:
    """The kind of a variant by its type; null for a JSON null."""
    # 5.0 is kept as DECIMAL(1,0), whole numbers as BIGINT or, beyond it, DECIMAL(19 and more,0)
    digits = F.regexp_extract(t, r"^DECIMAL\((\d+),0\)$", 1).try_cast("int")
    return (
        F.when(t == "STRING", "string")
        .when((t == "BIGINT") | (digits > 18), "whole")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "decimal")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "list")
        .when(t.startswith("OBJECT"), "object")
    )


def cells(rows: DataFrame, payload: str = "payload", ids: tuple[str, ...] = ("file_id", "line_no")) -> DataFrame:
    """(ids, field, kind, value): one row a field of each record; the kind of a JSON null is null."""
    told = rows.select(*ids, F.try_parse_json(payload).alias("_v")).filter(F.schema_of_variant("_v").like("OBJECT%"))
    opened = told.lateralJoin(told.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    typed = opened.select(*ids, F.col("key").alias("field"), F.schema_of_variant("value").alias("_t"), F.col("value").cast("string").alias("value"))
    return typed.select(*ids, "field", kind_of(F.col("_t")).alias("kind"), "value")


def file_schemas(rows: DataFrame) -> DataFrame:
    """The tagged union of each file: (file_id, field, n_<kind> for each alternative, kind, and a profile of the values)."""
    number = F.expr("try_cast(replace(substring_index(value, '/', 1), ',', '') as double)")
    got = (
        cells(rows)
        .groupBy("file_id", "field")
        .agg(
            *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS],
            F.avg(F.length("value")).alias("_length"),
            F.avg(F.log1p(F.abs(number))).alias("_size"),
            F.expr("bit_or(shiftleft(1L, cast(pmod(xxhash64(lower(translate(value, '[]\"', ''))), 63) as int)))").alias("_marks"),
        )
    )
    most = F.greatest(*[f"n_{k}" for k in KINDS])
    kind = F.when(F.col("n_decimal") > 0, "decimal").when(most > 0, F.coalesce(*[F.when(F.col(f"n_{k}") == most, k) for k in KINDS]))
    return got.withColumn("kind", kind)


def consecutive_files(files: DataFrame) -> DataFrame:
    """(file_id, before_id): each file with the file of its feed of the next earlier period."""
    w = Window.partitionBy("feed_id").orderBy("period", "received_at", "file_id")
    return files.select("file_id", F.lag("file_id").over(w).alias("before_id")).filter("before_id is not null")


def changes_between(old: list[dict], new: list[dict]) -> list[tuple[str, str, str]]:
    """(change, old_field, new_field) from one file's fields to the next one's.

    Fields are paired by the same name, then by the same quantity in the order of names, then, if one of the names is unknown, by
    profiles of their values: the closest pairs first, each field once.
    """
    before, after = {f["field"]: f for f in old}, {f["field"]: f for f in new}
    pairs = [(before[n], after[n]) for n in sorted(before.keys() & after.keys())]
    gone = [before[n] for n in sorted(before.keys() - after.keys())]
    come = [after[n] for n in sorted(after.keys() - before.keys())]
    for q in sorted({f["quantity"] for f in gone} & {f["quantity"] for f in come}):
        pairs += zip([f for f in gone if f["quantity"] == q], [f for f in come if f["quantity"] == q])
    taken = {id(f) for pair in pairs for f in pair}
    gone, come = ([f for f in fs if id(f) not in taken] for fs in (gone, come))
    close = []
    for a in gone:
        for b in come:
            if a["quantity"].startswith("?") or b["quantity"].startswith("?"):
                s = likeness(a, b)
                if s >= PROFILE_MATCH:
                    close.append((-s, a["field"], b["field"]))
    left, right = {f["field"]: f for f in gone}, {f["field"]: f for f in come}
    for _, x, y in sorted(close):
        if x in left and y in right:
            pairs.append((left.pop(x), right.pop(y)))
    out = [("removed", x, "") for x in left] + [("added", "", y) for y in right]
    for a, b in pairs:
        if a["field"] != b["field"]:
            out.append(("renamed", a["field"], b["field"]))
        if a["kind"] and b["kind"] and a["kind"] != b["kind"]:
            out.append(("retyped", a["field"], b["field"]))
    return out


def likeness(a: dict, b: dict) -> float:
    """How much two fields' values are alike: the values themselves, the size of numbers, lengths and kinds; 1 at most."""
    either = (a["marks"] | b["marks"]).bit_count()
    near = lambda x, y, none, unit: math.exp(-abs((none if x is None else x) - (none if y is None else y)) / unit)
    return (
        0.4 * ((a["marks"] & b["marks"]).bit_count() / either if either else 0.0)
        + 0.3 * near(a["size"], b["size"], -3.0, 1.0)
        + 0.2 * near(a["length"], b["length"], -9.0, 4.0)
        + 0.1 * (a["kind"] == b["kind"])
    )


def schema_changes(files: DataFrame, rows: DataFrame, names: dict = KNOWN_NAMES) -> DataFrame:
    """(file_id, change, old_field, new_field) for added, removed, renamed and retyped fields."""
    told = F.struct("field", "kind", quantity(F.col("field"), names).alias("quantity"), F.col("_length").alias("length"), F.col("_size").alias("size"), F.col("_marks").alias("marks"))
    # one row a file, so small beside the records; written once, as both sides of each comparison read it
    schemas = cut(file_schemas(rows).groupBy("file_id").agg(F.collect_list(told).alias("fields")))
    pairs = consecutive_files(files)
    new = schemas.select("file_id", F.col("fields").alias("new"))
    old = schemas.select(F.col("file_id").alias("before_id"), F.col("fields").alias("old"))
    both = pairs.join(new, "file_id", "left").join(old, "before_id", "left").select("file_id", "old", "new")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, olds, news = (batch.column(i).to_pylist() for i in range(3))
            got = [(i, *change) for i, a, b in zip(ids, olds, news) for change in changes_between(a or [], b or [])]
            columns = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()))],
                names=["file_id", "change", "old_field", "new_field"],
            )

    return both.mapInArrow(run, "file_id long, change string, old_field string, new_field string")


def union_schema(rows: DataFrame, names: dict = KNOWN_NAMES) -> DataFrame:
    """(quantity, field, kind, n): the alternatives of the fused schema over all files, with the number of values."""
    return (
        cells(rows)
        .filter("kind is not null")
        .groupBy("field", "kind")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(quantity(F.col("field"), names).alias("quantity"), "field", "kind", "n")
    )


def unified(rows: DataFrame, names: dict = KNOWN_NAMES) -> DataFrame:
    """One row a record in the canonical schema; ``<column>_branch`` names the alternative a converted value came from.

    Each record is opened where it lies, without a shuffle. Fields with unknown names, and further fields of a quantity that has its value from another,
    are kept in ``others`` as JSON. ``problem`` names what a record without fields is (null, not_json, not_object, empty), ``unread`` is its payload.
    """
    v = F.col("_v")
    is_object = F.coalesce(F.schema_of_variant(v).like("OBJECT%"), F.lit(False))
    problem = (
        F.when(F.col("payload").isNull(), "null").when(v.isNull(), "not_json").when(~is_object, "not_object")
        .when(F.schema_of_variant(v) == "OBJECT<>", "empty")
    )
    opened = F.map_entries(F.when(is_object, v).cast("map<string,variant>"))
    typed = F.transform(opened, lambda e: F.struct(e["key"], F.schema_of_variant(e["value"]).alias("t"), e["value"].cast("string").alias("value")))
    fields = F.transform(
        typed, lambda e: F.struct(quantity(e["key"], names).alias("quantity"), e["key"].alias("field"), kind_of(e["t"]).alias("kind"), e["value"])
    )
    parsed = rows.select("file_id", "line_no", "payload", F.try_parse_json("payload").alias("_v"))
    one = parsed.select(
        "file_id", "line_no", problem.alias("problem"), F.when(problem.isNotNull(), F.col("payload")).alias("unread"),
        F.array_sort(F.filter(fields, lambda f: f["kind"].isNotNull())).alias("_f"),
    )
    first = lambda q: F.get(F.filter("_f", lambda f: f["quantity"] == q), F.lit(0))
    wide = one.select(
        "file_id", "line_no", "problem", "unread", "_f", *[first(q).alias(f"_{q}_f") for q in names]
    )
    used = F.array(*[F.col(f"_{q}_f.field") for q in names])
    rest = F.filter("_f", lambda f: ~F.coalesce(F.array_contains(F.col("_used"), f["field"]), F.lit(False)))
    others = F.to_json(F.map_from_entries(F.transform(rest, lambda f: F.struct(f["field"], f["value"]))))
    wide = wide.withColumn("_used", F.filter(used, lambda x: x.isNotNull())).select(
        "file_id", "line_no", "problem", "unread", F.nullif(others, F.lit("{}")).alias("others"),
        *[F.col(f"_{q}_f.value").alias(f"_{q}") for q in names], *[F.col(f"_{q}_f.kind").alias(f"{q}_branch") for q in names],
    )
    number = lambda q: f"try_cast(regexp_replace(regexp_replace(_{q}, ',', ''), ' */.*$', '') as double)"
    text = lambda q: f"nullif(trim(regexp_replace(_{q}, '[\\\\[\\\\]\"]', '')), '')"
    canonical = {
        "search_volume": f"cast({number('search_volume')} as bigint)",
        "cpc": number("cpc"),
        "difficulty": number("difficulty"),
        "position": number("position"),
        "competition": f"case when {number('competition')} is null then upper({text('competition')})"
        f" when {number('competition')} < 0.34 then 'LOW' when {number('competition')} < 0.67 then 'MEDIUM' else 'HIGH' end",
        "branded": "case when lower(_branded) in ('true', 'yes', 'y', '1') then true when lower(_branded) in ('false', 'no', 'n', '0') then false end",
        "tags": f"array_join(array_sort(filter(split({text('tags')}, ' *, *'), x -> x <> '')), ',')",
        "seen_on": "coalesce(try_to_date(_seen_on, 'yyyy-MM-dd'), try_to_date(_seen_on, 'yyyyMMdd'))",
    }
    columns = [F.expr(canonical.get(q, text(q))).alias(q) for q in names]
    return wide.select("file_id", "line_no", *columns, *[f"{q}_branch" for q in names], "others", "problem", "unread")
