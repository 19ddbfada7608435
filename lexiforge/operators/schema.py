"""Header resolution and projection to the canonical columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of the keyword column, and accepted names of each canonical column in order of preference.
KEYWORD_ALIASES = (
    "keyword", "keywords", "search query", "search queries", "query", "queries", "search term", "search terms", "term",
    "keyword text", "organic keyword", "top queries", "search keyword",
)
SCHEMA_ALIASES = {
    "keyword": ("keyword", "search keyword", "query", "search query"),
    "volume": ("volume", "search volume", "sv", "current search volume"),
    "competition": ("competition", "comp"),
    "cpc": ("cpc", "cost per click"),
    "intent": ("intent", "search intent"),
    "language": ("language", "lang"),
    "country": ("country", "loc", "location"),
    "source": ("source", "src"),
}
FUZZY_THRESHOLD = 90.0


class SchemaError(ValueError):
    """A required column is missing or can't be told."""


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def resolve_keyword_column(columns: list[str], aliases=KEYWORD_ALIASES, threshold: float = FUZZY_THRESHOLD) -> list[tuple[str, str, float]]:
    """(column, method, score) of all candidates, best first; exact 100, alias 95, else the best similarity to an alias."""
    found = []
    for c in columns:
        name = c.lower().strip()
        if name == "keyword":
            found.append((c, "EXACT", 100.0))
        elif name in aliases:
            found.append((c, "ALIAS", 95.0))
        else:
            best = max((ratio(name, a) for a in aliases), default=0.0)
            if best >= threshold:
                found.append((c, "FUZZY", round(best, 2)))
    if not found:
        raise SchemaError(f"no column holds keywords: {columns}")
    return sorted(found, key=lambda r: -r[2])


def canonical_headers(df: DataFrame) -> DataFrame:
    """Headers without outer blanks and in lower case; headers that then clash are numbered from the second on."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        n = c.strip().lower()
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}#{seen[n]}")
    return df.toDF(*names)


def project_canonical(df: DataFrame, aliases=SCHEMA_ALIASES) -> tuple[DataFrame, list[str]]:
    """The canonical columns present, in canonical order, and the columns left out."""
    df = canonical_headers(df)
    chosen = {c: next((a for a in names if a in df.columns), None) for c, names in aliases.items()}
    if not chosen.get("keyword"):
        raise SchemaError(f"missing required column: keyword; got {df.columns}")
    taken = {c: a for c, a in chosen.items() if a}
    return df.select(*[F.col(f"`{a}`").alias(c) for c, a in taken.items()]), [c for c in df.columns if c not in taken.values()]


def drop_blank_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def drop_empty_keywords(df: DataFrame, column: str = "keyword") -> DataFrame:
    """Null counts as empty; blanks alone stay."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(""))).filter(F.col(column) != "")


def first_of_each(df: DataFrame, column: str = "keyword", order: str = "row_id") -> DataFrame:
    """The first row of each value. A map-side minimum finds it, so a value with a third of all rows isn't gathered."""
    first = df.groupBy(column).agg(F.min(order).alias("_first"))
    return df.join(first.select(F.col("_first").alias(order)), order, "left_semi")


def numbered(df: DataFrame, column: str = "row_id") -> DataFrame:
    """Row numbers that keep the order of the input."""
    return df if column in df.columns else df.withColumn(column, F.monotonically_increasing_id())


