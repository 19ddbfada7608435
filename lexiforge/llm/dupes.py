"""Duplicates hidden by formatting differences.

Records are brought to a canonical key in the JVM. Each partition marks the 64-bit hashes of its keys in two Bloom
filters, seen once and seen repeatedly; the partitions' filters are merged shard by shard (what two partitions saw
once counts as repeated) in a tree of bounded groups, so a key that occurs twice is always in the merged repeated filter. Only records that the
filter lets through are shuffled for exact grouping on the whole key; all others go out as singletons, unshuffled.

Filters have a fixed size per key and a cap in bytes; beyond the cap the key space is worked off in several passes, so
what is broadcast never exceeds ``MAX_FILTER_BYTES`` at any size of the data; the keys are then written once beforehand. Groups with very many copies are joined
apart, by a broadcast of their few keys, so no task gets all copies of one record.

Records with a null keyword have nothing to compare and are singletons; an empty keyword is a keyword like any other;
null fields equal null fields. Empty input gives empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.runtime import cut

SHARD_BITS = 19  # a shard of a filter is 64 KB
BITS_PER_KEY = 16
MAX_FILTER_BYTES = 128 << 20
MERGED_AT_ONCE = 64  # filters of a shard that one task merges
HOT_COPIES = 50_000
HOT_KEYS = 5_000


def canonical_text(c: Column) -> Column:
    """Without letter case, white space and punctuation."""
    bare = F.regexp_replace(c, r"[\p{P}\p{IsWhite_Space}]+", "")
    return F.regexp_replace(F.lower(F.upper(bare)), "[ßẞ]", "ss")


def canonical_fields(c: Column) -> Column:
    """name=value fields as a sorted set without case and blanks; null stays null."""
    parts = F.transform(F.split(F.lower(F.upper(c)), ";"), lambda x: F.regexp_replace(x, r"\p{IsWhite_Space}+", ""))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))), ";")


def keyed(df: DataFrame, src: str, scope: str, keyword: str, rest: list[Column]) -> DataFrame:
    """(src, row_id, keyword, key): records of one source with the key on which copies agree."""
    told = [F.coalesce(F.concat(F.lit("="), r.cast("string")), F.lit("-")) for r in rest]
    own = [F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit("-"))]
    key = F.concat_ws("\x1f", *own, canonical_text(F.col(keyword)), *told)
    return df.select(
        F.lit(src).alias("src"), "row_id", F.col(keyword).alias("keyword"), F.when(F.col(keyword).isNotNull(), key).alias("key")
    )


def keyword_records(demo: DataFrame, dup_rows: DataFrame) -> DataFrame:
    a = keyed(demo, "demo_keywords", "upload_id", "keyword", [F.col("search_volume"), F.col("language"), F.col("country")])
    b = keyed(dup_rows, "duplicate_rows", "upload_id", "keyword", [F.col("volume"), canonical_fields(F.col("attrs"))])
    return a.unionByName(b).withColumn("hash", F.xxhash64("src", "key"))


def _places(hashes, shards: int):
    """Shard and two bit positions of each hash."""
    import numpy as np

    h = hashes.view(np.uint64)
    mask = np.uint64((1 << SHARD_BITS) - 1)
    shard = ((h >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
    return shard, (h & mask).astype(np.int64), ((h >> np.uint64(SHARD_BITS)) & mask).astype(np.int64)


def _bits(*positions) -> bytes:
    import numpy as np

    flags = np.zeros(1 << SHARD_BITS, dtype=np.uint8)
    for p in positions:
        flags[p] = 1
    return np.packbits(flags).tobytes()


def repeated_filter(hashes: DataFrame, shards: int) -> DataFrame:
    """(shard, bits): the merged filter of hashes that may occur more than once."""

    def build(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        got = [pdf["hash"].to_numpy() for pdf in batches]
        if not got:
            return
        values, counts = np.unique(np.concatenate(got), return_counts=True)
        shard, p, q = _places(values, shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in range(shards):
            own = order[cuts[s] : cuts[s + 1]]
            if len(own):
                again = own[counts[own] > 1]
                yield pd.DataFrame(
                    {
                        "shard": [s],
                        "once": [zlib.compress(_bits(p[own], q[own]), 1)],
                        "again": [zlib.compress(_bits(p[again], q[again]), 1)],
                    }
                )

    def merge(pdf):
        import numpy as np
        import pandas as pd

        once = np.zeros(1 << (SHARD_BITS - 3), dtype=np.uint8)
        again = once.copy()
        for a, b in zip(pdf["once"], pdf["again"]):
            seen = np.frombuffer(zlib.decompress(a), dtype=np.uint8)
            again |= (once & seen) | np.frombuffer(zlib.decompress(b), dtype=np.uint8)
            once |= seen
        return pd.DataFrame(
            {"shard": [int(pdf["shard"].iloc[0])], "once": [zlib.compress(once.tobytes(), 1)], "again": [zlib.compress(again.tobytes(), 1)]}
        )

    schema = "shard long, once binary, again binary"
    parts = hashes.select("hash").mapInPandas(build, schema).withColumn("part", F.spark_partition_id())
    n_parts = hashes.rdd.getNumPartitions()
    while n_parts > MERGED_AT_ONCE:  # a level of the tree
        n_parts = -(-n_parts // MERGED_AT_ONCE)
        merged = parts.groupBy("shard", F.pmod("part", F.lit(n_parts)).alias("part")).applyInPandas(
            lambda key, pdf: merge(pdf).assign(part=int(key[1])), schema + ", part int"
        )
        parts = cut(merged)
    return parts.groupBy("shard").applyInPandas(merge, schema).select("shard", F.col("again").alias("bits"))


def flag_possible_repeats(records: DataFrame, n_keys: int | None = None, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Adds ``maybe``: false only for records that certainly have no copy."""
    n = records.count() if n_keys is None else n_keys
    shards_needed = max(1, -(-n * BITS_PER_KEY >> SHARD_BITS) if n else 1)
    per_pass = max(1, max_filter_bytes >> (SHARD_BITS - 3))
    passes = -(-shards_needed // per_pass)
    shards = -(-shards_needed // passes)
    spark = records.sparkSession
    if passes > 1:
        records = cut(records)
    out = None
    for k in range(passes):
        # a hash of the hash, so that the bits of a pass are independent of the places in its filter
        mine = records if passes == 1 else records.filter(F.pmod(F.xxhash64("hash", F.lit(1)), F.lit(passes)) == k)
        rows = repeated_filter(mine.filter(F.col("key").isNotNull()), shards).collect()  # at most max_filter_bytes
        told = spark.sparkContext.broadcast({r.shard: bytes(r.bits) for r in rows})

        def test(batches: Iterator, told=told, shards=shards) -> Iterator:
            import numpy as np
            import pyarrow as pa

            bits = np.zeros((shards, 1 << (SHARD_BITS - 3)), dtype=np.uint8)
            for s, b in told.value.items():
                bits[s] = np.frombuffer(zlib.decompress(b), dtype=np.uint8)
            for batch in batches:
                h = batch.column(batch.schema.get_field_index("hash")).to_numpy(zero_copy_only=False)
                shard, p, q = _places(np.ascontiguousarray(h), shards)
                hit = ((bits[shard, p >> 3] >> (7 - (p & 7))) & 1) & ((bits[shard, q >> 3] >> (7 - (q & 7))) & 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit.astype(bool))], names=[*batch.schema.names, "maybe"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in mine.schema.fields)
        flagged = mine.mapInArrow(test, fields + ", maybe boolean")
        out = flagged if out is None else out.unionByName(flagged)
    return out.withColumn("maybe", F.col("maybe") & F.col("key").isNotNull())


def copy_groups(candidates: DataFrame) -> DataFrame:
    """(src, key, keep_id, n_copies) of the keys that occur more than once; reduced on the map side."""
    return (
        candidates.groupBy("src", "key")
        .agg(F.min("row_id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies"))
        .filter("n_copies > 1")
    )


def copies(records: DataFrame) -> DataFrame:
    """(src, keep_id, dup_id): each copy with the record that stands for its group."""
    candidates = cut(flag_possible_repeats(records).filter("maybe").select("src", "row_id", "key"))
    groups = cut(copy_groups(candidates))
    size = candidates.count()
    hot_from = max(HOT_COPIES, size // HOT_KEYS)
    hot = groups.filter(F.col("n_copies") > hot_from)  # at most HOT_KEYS rows, since each stands for more than size / HOT_KEYS
    cold = groups.filter(F.col("n_copies") <= hot_from)
    parts = [candidates.join(cold, ["src", "key"])]
    if not hot.isEmpty():
        parts.append(candidates.join(F.broadcast(hot), ["src", "key"]))
    out = None
    for part in parts:
        pairs = part.filter("row_id <> keep_id").select("src", "keep_id", F.col("row_id").alias("dup_id"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def collapsed(records: DataFrame) -> DataFrame:
    """(src, row_id, keyword, n_copies): one record for each group of copies, and every record that has none."""
    flagged = cut(flag_possible_repeats(records).select("src", "row_id", "keyword", "key", "maybe"))
    alone = flagged.filter("not maybe").select("src", "row_id", "keyword", F.lit(1).cast("long").alias("n_copies"))
    grouped = (
        flagged.filter("maybe")
        .groupBy("src", "key")
        .agg(F.min(F.struct("row_id", "keyword")).alias("kept"), F.count(F.lit(1)).alias("n_copies"))
        .select("src", "kept.row_id", "kept.keyword", "n_copies")
    )
    return alone.unionByName(grouped)
