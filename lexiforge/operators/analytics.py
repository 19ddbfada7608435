"""Distributions, summaries and top lists over keyword tables; column names are parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTENTS = ("informational", "navigational", "commercial", "transactional", "unknown")


def dataset_stats(df: DataFrame, column: str = "keyword") -> DataFrame:
    """(total, n_unique, duplicates); nulls are no values."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(column).alias("n_unique")).select(
        "total", "n_unique", (F.col("total") - F.col("n_unique")).alias("duplicates")
    )


def fixed_buckets(df: DataFrame, column: str, buckets: tuple[str, ...]) -> DataFrame:
    """One row with the count of each bucket."""
    return df.agg(*[F.count_if(F.col(column) == b).alias(b) for b in buckets])


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """Counts by value, nulls left out."""
    kept = df
    for c in columns:
        kept = kept.filter(F.col(c).isNotNull())
    return kept.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def middle(df: DataFrame, column: str, buckets: int = 4096) -> DataFrame:
    """(median): the exact median without holding all values in one task.

    Values are counted in equal ranges between the least and the most; the ranges that hold the middle are then counted value by value,
    narrower each time, until a range has one value or few. Null and NaN are no values; without any the result is one null.
    """
    v = df.select(F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    low, high, n = v.agg(F.min("v"), F.max("v"), F.count("v")).first()
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([(None,)], "median double")

    def ranked(k: int) -> float:
        """The k-th value from 0."""
        a, b, rank = low, high, k
        while a < b:
            step = (b - a) / buckets
            if step == 0 or a + step == a:
                break
            place = F.least(F.floor((F.col("v") - a) / step), F.lit(buckets - 1))
            rows = v.filter(F.col("v").between(a, b)).groupBy(place.alias("p")).agg(F.count("v").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("p").collect()
            for r in rows:  # at most ``buckets`` rows
                if rank < r.n:
                    a, b = r.a, r.b
                    break
                rank -= r.n
        return a

    half = (n - 1) // 2
    first = ranked(half)
    second = first if n % 2 else ranked(half + 1)
    return spark.createDataFrame([((first + second) / 2,)], "median double")


def number_stats(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, least, most, valid and missing of a column that may hold text; 0 where there are no values."""
    v = df.select(F.expr(f"try_cast({column} as double)").alias("v"))
    most = v.agg(
        F.round(F.coalesce(F.avg("v"), F.lit(0.0)), 4).alias("mean"), F.coalesce(F.min("v"), F.lit(0.0)).alias("least"), F.coalesce(F.max("v"), F.lit(0.0)).alias("most"),
        F.count("v").alias("n_valid"), (F.count(F.lit(1)) - F.count("v")).alias("n_missing"),
    )
    median = middle(v, "v").first()[0] or 0.0
    return most.select("mean", F.lit(float(median)).alias("median"), "least", "most", "n_valid", "n_missing")


#: Buckets of reports.
RELEVANCES = ("relevant", "irrelevant", "uncertain")
QUALITIES = ("excellent", "good", "fair", "poor", "unknown")


def relevance_distribution(df: DataFrame, relevant: Column, reviewed: Column) -> DataFrame:
    """One row with the rows of each relevance: those for a review are uncertain, whatever else they are."""
    r = F.when(F.coalesce(reviewed, F.lit(False)), "uncertain").when(F.coalesce(relevant, F.lit(False)), "relevant").otherwise("irrelevant")
    return fixed_buckets(df.select(r.alias("relevance")), "relevance", RELEVANCES)


def quality_distribution(df: DataFrame, confidence: str, steps: tuple[float, float, float] = (0.9, 0.75, 0.5)) -> DataFrame:
    """One row with the rows of each quality; null and NaN are unknown."""
    c = F.expr(f"try_cast({confidence} as double)")
    q = F.when(c.isNull() | F.isnan(c), "unknown")
    for bound, name in zip(steps, QUALITIES):
        q = q.when(c >= bound, name)
    return fixed_buckets(df.select(q.otherwise("poor").alias("quality")), "quality", QUALITIES)


def accounting(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """(total, <part> ..., balanced): whether each row is in just one of the parts."""
    held = sum((F.coalesce(c, F.lit(False)).cast("int") for c in parts.values()), F.lit(0))
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in parts.items()], (F.count_if(held != 1) == 0).alias("balanced")
    )
    return counts


def health(errors: int, warnings: int = 0) -> str:
    """HEALTHY, or DEGRADED if a stage had an error."""
    return "DEGRADED" if errors else "HEALTHY"


def key_figures(df: DataFrame, group: str, flags: dict[str, Column]) -> DataFrame:
    """(metric, n): rows, distinct groups and rows with each flag, one a row, as dashboards and summary sheets show them."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias(f"distinct_{group}"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
    names = row.columns
    return row.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, `{n}`' for n in names)}) as (metric, n)"))


def top_rows(df: DataFrame, by: str, n: int = 10, tie: str = "row_id", keep: tuple[str, ...] = ("keyword",)) -> DataFrame:
    """The n rows of the largest values; ties go to the smaller id."""
    v = F.expr(f"try_cast({by} as double)")
    return df.select(tie, *keep, v.alias("v")).filter("v is not null").orderBy(F.desc("v"), tie).limit(n).select(tie, *keep, F.col("v").cast("long").alias(by))


def top_value(df: DataFrame, column: str) -> DataFrame:
    """(value, n): the most frequent value; ties go to the lesser one."""
    return distribution(df, column).orderBy(F.desc("n"), column).limit(1).select(F.col(column).alias("value"), "n")


def dominant(df: DataFrame, column: str, buckets: tuple[str, ...] = INTENTS) -> DataFrame:
    """(value): the bucket with the highest count, ties in declared order, '' if all are empty."""
    counts = fixed_buckets(df, column, buckets)
    most = F.greatest(*[F.col(f"`{b}`") for b in buckets])
    first: Column = F.lit("")
    for b in reversed(buckets):
        first = F.when(F.col(f"`{b}`") == most, b).otherwise(first)
    return counts.select(F.when(most == 0, "").otherwise(first).alias("value"))


def mean_number(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.round(F.avg(F.expr(f"try_cast({column} as double)")), 6).alias("mean"))


def summary(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """(total, <flag> ...): rows in all and rows with each flag, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def percentages(row: DataFrame, total: str, names: tuple[str, ...]) -> DataFrame:
    """Shares of a total as text with one digit, as reports show them."""
    shown = lambda c: F.when(F.col(total) > 0, F.concat(F.format_string("%.1f", F.round(F.col(c) * 100.0 / F.col(total), 1)), F.lit("%"))).otherwise("0.0%")
    return row.select(*[shown(n).alias(f"{n}_pct") for n in names])


def quality_gates(df: DataFrame, confidence: str, required: tuple[str, ...]) -> DataFrame:
    """(gate, passed): rows exist, required columns exist, confidences lie in [0, 1] (null and NaN don't)."""
    c = F.col(confidence)
    got = df.agg((F.count(F.lit(1)) > 0).alias("has_rows"), (F.count_if(~F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False))) == 0).alias("confidence_in_range"))
    columns = all(r in df.columns for r in required)
    return got.select(F.expr(f"stack(3, 'has_rows', has_rows, 'confidence_in_range', confidence_in_range, 'required_columns', {str(columns).lower()}) as (gate, passed)"))


def out_of_range(df: DataFrame, column: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    c = F.col(column)
    return df.filter(~F.coalesce(c.between(low, high) & ~F.isnan(c), F.lit(False)))


def timer_snapshot(events: DataFrame, metric: str, value: str) -> DataFrame:
    """(metric, n, mean, most)."""
    return events.groupBy(F.col(metric).alias("metric")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 4).alias("mean"), F.max(value).alias("most"))


def export_order(df: DataFrame, flag: str, by: str, tie: str = "row_id") -> DataFrame:
    """Flagged rows first, then by value, nulls last."""
    return df.orderBy(F.desc(flag), F.desc_nulls_last(by), tie)
