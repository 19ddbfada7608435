"""Batched, cached look-ups: deterministic stand-ins for outside providers, cache split, merge, JSON repair."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.runtime import join_unique

TWO32 = 1 << 32


def hash_mod(c: Column, modulus: int) -> Column:
    """The MD5 of a string as a 128-bit number, modulo a small number: four 32-bit parts folded."""
    digest = F.md5(c)
    r = F.lit(0).cast("long")
    for i in range(4):
        part = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
        r = (r * (TWO32 % modulus) + part) % modulus
    return r


def mock_volume(keywords: DataFrame, column: str = "keyword") -> DataFrame:
    """(keyword, search_volume, competition, cpc) made from the keyword's hash, one row a distinct keyword."""
    one = keywords.filter(F.col(column).isNotNull()).select(F.col(column).alias("keyword")).distinct()
    k = F.col("keyword")
    level = hash_mod(k, 100)
    return one.select(
        "keyword",
        (10 + hash_mod(k, 499_990)).alias("search_volume"),
        F.when(level < 30, "LOW").when(level < 70, "MEDIUM").otherwise("HIGH").alias("competition"),
        F.round(0.05 + hash_mod(k, 4995) / 100, 2).alias("cpc"),
    )


def mock_classes(keywords: DataFrame, column: str = "keyword") -> DataFrame:
    """(keyword, relevance, confidence) made from the keyword's hash."""
    one = keywords.filter(F.col(column).isNotNull()).select(F.col(column).alias("keyword")).distinct()
    k = F.col("keyword")
    kind = hash_mod(k, 3)
    return one.select(
        "keyword",
        F.when(kind == 0, "RELEVANT").when(kind == 1, "IRRELEVANT").otherwise("UNCERTAIN").alias("relevance"),
        F.round(0.5 + hash_mod(k, 51) / 100, 2).alias("confidence"),
    )


def cache_split(keywords: DataFrame, cache: DataFrame, column: str = "keyword") -> tuple[DataFrame, DataFrame]:
    """(hits with the cache's columns, distinct keywords to look up)."""
    wanted = keywords.filter(F.col(column).isNotNull()).select(column).distinct()
    return wanted.join(cache, column), wanted.join(cache.select(column), column, "left_anti")


def batches(keywords: DataFrame, size: int, provider_most: int, column: str = "keyword", buckets: int = 1024) -> DataFrame:
    """(keyword, batch_no): the distinct keywords in order, cut into slices of at most ``size``.

    Positions come from counts of ordered buckets plus a rank inside each, so no task sorts everything.
    """
    from pyspark.sql import Window

    n = max(1, min(size, provider_most))
    one = keywords.filter(F.col(column).isNotNull()).select(F.col(column).alias("keyword")).distinct()
    put = one.withColumn("_b", F.conv(F.substring(F.md5("keyword"), 1, 4), 16, 10).cast("int") % buckets)
    sizes = put.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).alias("_s"))  # one row a bucket
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("keyword")) - 1
    placed = put.withColumn("_r", rank).join(start, "_b")
    return placed.select("keyword", F.floor((F.coalesce("_s", F.lit(0)) + F.col("_r")) / n).alias("batch_no"))


def run_batches(wanted: DataFrame, provider: Callable[[list[str]], list[dict]], schema: str, size: int = 1000, attempts: int = 3, column: str = "keyword") -> DataFrame:
    """Calls a provider batch by batch inside the partitions; a batch that fails every attempt gives rows with ``error``.

    ``schema`` are the provider's columns, keyword first. Look-ups must be idempotent, as a lost task calls again.
    """
    fatal = ("exhausted", "expired", "401", "402", "403", "quota")

    def call(keys: list[str]) -> tuple[list[dict], str | None]:
        error = None
        for _ in range(attempts):
            try:
                return provider(keys), None
            except Exception as e:  # noqa: BLE001  a provider may raise anything
                error = str(e) or type(e).__name__
                if any(f in error.lower() for f in fatal):
                    break
        return [], error

    names = [f.split()[0] for f in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            keys = pdf[column].tolist()
            for i in range(0, len(keys), size):
                some = keys[i : i + size]
                rows, error = call(some)
                out = pd.DataFrame(rows, columns=names) if error is None else pd.DataFrame({names[0]: some}).reindex(columns=names)
                out["error"] = error
                yield out

    return wanted.select(column).mapInPandas(run, schema + ", error string")


def merge_results(df: DataFrame, results: DataFrame, columns: list[str], order: str = "ord", column: str = "keyword") -> DataFrame:
    """Left look-up join: the last result of each keyword goes to all its rows; rows without one keep their values."""
    last = results.groupBy(column).agg(F.max_by(F.struct(*columns), order).alias("_r"))
    joined = join_unique(df, last, column)
    kept = [F.coalesce(F.col(f"_r.{c}"), F.col(c)).alias(c) if c in df.columns else F.col(f"_r.{c}").alias(c) for c in columns]
    return joined.select(*[c for c in df.columns if c not in columns], *kept)


def lookup_statistics(keywords: DataFrame, cache: DataFrame, column: str = "keyword", size: int = 1000) -> DataFrame:
    """(total, hits, misses, batches, hit_ratio) over the distinct keywords."""
    wanted = keywords.filter(F.col(column).isNotNull()).select(column).distinct()
    marked = wanted.join(cache.select(column, F.lit(1).alias("_c")).distinct(), column, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.count("_c").alias("hits")).select(
        "total", "hits", (F.col("total") - F.col("hits")).alias("misses"),
        F.ceil((F.col("total") - F.col("hits")) / size).cast("long").alias("batches"),
        F.round(F.when(F.col("total") > 0, F.col("hits") / F.col("total")).otherwise(0.0), 6).alias("hit_ratio"),
    )


# --- answers that should be JSON


def _whole(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def _scattered(text: str):
    """Objects that stand anywhere in a text, read from each brace on by the decoder itself."""
    read, rows, at = json.JSONDecoder().raw_decode, [], text.find("{")
    while at >= 0:
        try:
            got, end = read(text, at)
            rows.append(got)
        except ValueError:
            end = at + 1
        at = text.find("{", end)
    return rows or None


def repair_json(raw: str | None) -> list[dict]:
    """Rows of an answer: whole JSON or the objects in it; wrappers and column-wise answers are opened."""
    text = (raw or "").strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0].strip()
    got = _whole(text)
    if got is None:
        got = _scattered(text)
    if isinstance(got, dict):
        if got and all(isinstance(v, list) for v in got.values()) and len(got) > 1 and len({len(v) for v in got.values()}) == 1:
            got = [dict(zip(got, row)) for row in zip(*got.values())]
        elif got and all(isinstance(v, dict) for v in got.values()):
            got = [{"keyword": k, **v} for k, v in got.items()]
        else:
            lists = [v for v in got.values() if isinstance(v, list)]
            got = lists[0] if len(got) == 1 and lists else got.get("keywords") or got.get("results") or [got]
    return [r for r in got if isinstance(r, dict)] if isinstance(got, list) else []


def parse_answers(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(answer_id, pos, item): JSON objects of each answer. Sound arrays are read in the JVM, only the rest goes to Python."""
    fast = F.expr(f"try_parse_json({column})")
    marked = answers.select("answer_id", column, fast.alias("_v")).withColumn("_sound", F.expr("coalesce(schema_of_variant(_v) like 'ARRAY<OBJECT%', false)"))
    good = marked.filter("_sound").select("answer_id", F.expr("posexplode(cast(_v as array<variant>))").alias("pos", "item"))
    good = good.select("answer_id", "pos", F.expr("to_json(item)").alias("item"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            got = [(i, k, json.dumps(r, ensure_ascii=False, separators=(",", ":"))) for i, a in enumerate(texts) for k, r in enumerate(repair_json(a))]
            owner, places, items = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), pa.array(places, pa.int32()), pa.array(items, pa.string())], names=["answer_id", "pos", "item"])

    # the id may be of any type, a struct too
    kind = answers.schema["answer_id"].dataType.simpleString()
    bad = marked.filter("not _sound").select("answer_id", column).mapInArrow(run, f"answer_id {kind}, pos int, item string")
    return good.unionByName(bad)


def valid_items(items: DataFrame, required: tuple[str, ...] = ("keyword", "relevance"), relevances: tuple[str, ...] = ("RELEVANT", "IRRELEVANT", "UNCERTAIN")) -> DataFrame:
    """The items with all required fields and a known relevance."""
    ok = F.lit(True)
    for r in required:
        ok = ok & F.get_json_object("item", f"$.{r}").isNotNull()
    return items.filter(ok & F.get_json_object("item", "$.relevance").isin(*relevances))
