"""Rows that fail to parse: split raw CSV lines into typed rows and rejected rows with a reason.

Every line is taken apart into cells inside the JVM (no Python) and exploded to (row, column, value), with its shape as one more
cell; a line of another shape has no cells besides. All are joined to a rule table, which holds the rules of quoting and of the number of columns as
well as those of the values; the failed rules are aggregated to the first reason of each row, and an anti-join against the failed rows
leaves the clean ones, which are pivoted to typed columns.

Quote handling works on the pieces between quote characters. In a well-formed record the pieces
alternate between outside and inside of quotes; an inner piece outside of quotes is either empty (a
doubled quote) or holds a comma with nothing but blanks between the comma nearest to a quote and that quote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# commas inside of quotes are written as a code while the line is split; the code's own sign is written as another code, so no text is altered
SIGN, COMMA_CODE, SIGN_CODE = "\x01", "\x01a", "\x01b"
SHAPE = -1  # position of the cell that holds a line's shape
BLANK = r"[\s ]"


@dataclass(frozen=True)
class ColumnRule:
    """A column of the expected record: a value is valid if it matches ``pattern`` (and is a real date)."""

    position: int
    name: str
    pattern: str
    is_date: bool = False


KEYWORD_EXPORT = (
    ColumnRule(0, "keyword", r"(?s).+"),
    ColumnRule(1, "volume", r"[0-9]*"),
    ColumnRule(2, "cpc", r"([0-9]+(\.[0-9]+)?)?"),
    ColumnRule(3, "country", r"([A-Z]{2})?"),
    ColumnRule(4, "seen_on", r"([0-9]{4}-[0-9]{2}-[0-9]{2})?", is_date=True),
)


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}++|{BLANK}++$", "")


def parse_cells(df: DataFrame, line: str = "raw_line") -> DataFrame:
    """Adds ``_ok`` (quoting is sound) and ``_cells`` (trimmed cell values) to each line."""
    coded = lambda c: F.replace(c, F.lit(SIGN), F.lit(SIGN_CODE))
    decoded = lambda c: F.replace(F.replace(c, F.lit(COMMA_CODE), F.lit(",")), F.lit(SIGN_CODE), F.lit(SIGN))
    df = df.withColumn("_pieces", F.split(coded(F.col(line)), '"', -1))
    # lambdas see only their own piece and its place: a reference to the whole array in them would be evaluated for each piece
    n = F.size("_pieces")
    first, last = F.element_at("_pieces", 1), F.element_at("_pieces", -1)
    middle = F.slice("_pieces", 2, F.greatest(n - 2, F.lit(0)))
    opens = lambda p: p.rlike(rf"(?s)(^|,){BLANK}*+$")  # noqa: E731  what stands before an opening quote
    closes = lambda p: p.rlike(rf"(?s)^{BLANK}*+(,|$)")  # noqa: E731  what stands after a closing quote
    # in the middle odd places (from 0) are outside of quotes
    between = F.forall(F.filter(middle, lambda p, i: i % 2 == 1), lambda p: (p == "") | (closes(p) & opens(p) & p.contains(",")))
    sound = (n % 2 == 1) & ((n == 1) | (opens(first) & closes(last) & between))
    inner = F.transform(
        middle, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(COMMA_CODE))).when(p == "", F.lit('"')).otherwise(p)
    )
    text = F.when(n == 1, first).otherwise(F.concat(first, F.array_join(inner, ""), last))
    return (
        df.withColumn("_ok", sound)
        .withColumn("_cells", F.transform(F.split(text, ",", -1), lambda c: _trim(decoded(c))))
        .drop("_pieces")
    )


def rule_table(df: DataFrame, rules=KEYWORD_EXPORT) -> DataFrame:
    """The rules as a table, in order of the reasons; its size is the number of expected columns and two, so it is broadcast."""
    rows = [(SHAPE, 0, "quoting", "", r"^sound:", False), (SHAPE, 1, "column_count", "", rf":{len(rules)}$", False)]
    rows += [(r.position, 2, "invalid_value", r.name, rf"(?s)^(?:{r.pattern})$", r.is_date) for r in rules]
    return df.sparkSession.createDataFrame(rows, "pos int, rank int, reason string, rule string, pattern string, is_date boolean")


def _lines(df: DataFrame, key: str, line: str, line_no: str) -> DataFrame:
    looked_at = (F.col(line_no) != 1) & (F.regexp_replace(F.col(line), rf"{BLANK}+", "") != "")
    return parse_cells(df.filter(looked_at).select(key, line), line)


def rejected_rows(df: DataFrame, rules=KEYWORD_EXPORT, key="line_id", line="raw_line", line_no="line_no") -> DataFrame:
    """(key, reason, detail) of each line that doesn't parse; the first of quoting, column_count, invalid_value.

    Header lines (line_no 1), null and blank lines are not looked at. ``detail`` names the columns at fault.
    An empty input gives an empty result; columns besides the three named are ignored, whatever their names.
    """
    lines = _lines(df, key, line, line_no)
    shape = F.concat(F.when(F.col("_ok"), "sound").otherwise("broken"), F.lit(":"), F.size("_cells"))
    cell = lambda pos, value: F.struct(pos.cast("int").alias("pos"), value.alias("value"))
    own = F.when(F.col("_ok") & (F.size("_cells") == len(rules)), F.transform("_cells", lambda c, i: cell(i, c)))
    told = F.concat(F.array(cell(F.lit(SHAPE), shape)), F.coalesce(own, F.array().cast("array<struct<pos:int,value:string>>")))
    cells = lines.select(F.col(key), F.inline(told))
    # '0000' is no year; try_to_date is null for days that don't exist
    real = (F.col("value") == "") | (
        F.try_to_date(F.col("value"), "yyyy-MM-dd").isNotNull() & ~F.col("value").startswith("0000")
    )
    failed = cells.join(F.broadcast(rule_table(df, rules)), "pos").filter(
        ~F.expr("value rlike pattern") | (F.col("is_date") & F.expr("value rlike pattern") & ~real)
    )
    # the cells of a line stay in one partition up to here, so the aggregate below reduces before it shuffles
    first = failed.groupBy(key).agg(F.min(F.struct("rank", "reason")).alias("_first"), F.collect_set(F.nullif("rule", F.lit(""))).alias("_rules"))
    return first.select(key, "_first.reason", F.array_join(F.array_sort("_rules"), ",").alias("detail"))


def clean_rows(df: DataFrame, rules=KEYWORD_EXPORT, key="line_id", line="raw_line", line_no="line_no") -> DataFrame:
    """Typed rows of the valid lines: (key, keyword, volume, cpc, country, seen_on, volume_text); empty cells are null.

    ``volume`` has up to 38 digits; a longer one is null there, and ``volume_text`` has its digits.
    """
    bad = rejected_rows(df, rules, key, line, line_no).select(key)
    good = _lines(df, key, line, line_no).join(bad, key, "left_anti")
    cell = lambda i: F.nullif(F.get("_cells", F.lit(i)), F.lit(""))
    return good.select(
        key,
        cell(0).alias("keyword"),
        F.expr("try_cast(nullif(get(_cells, 1), '') as decimal(38,0))").alias("volume"),
        F.expr("try_cast(nullif(get(_cells, 2), '') as double)").alias("cpc"),
        cell(3).alias("country"),
        F.try_to_date(cell(4), "yyyy-MM-dd").alias("seen_on"),
        F.expr("case when try_cast(nullif(get(_cells, 1), '') as decimal(38,0)) is null then nullif(get(_cells, 1), '') end").alias("volume_text"),
    )
