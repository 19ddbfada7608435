"""Readers: strict CSV, workbooks, JSON and YAML dictionaries, and dispatch by suffix."""

from __future__ import annotations

import json
import os
import re
import tempfile
import zipfile
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENCODINGS = ("utf-8", "utf-8-sig", "iso-8859-1")
# Cell texts that mean a missing value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
    "None", "n/a", "nan", "null",
)
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class InputError(ValueError):
    """An input can't be read: empty, malformed, of an unknown format, or without the sheet asked for."""


def _encoding(path: str) -> str:
    """The first encoding that decodes the head of the file."""
    if not os.path.exists(path):
        return "utf-8"  # on a file system the driver doesn't mount
    if os.path.getsize(path) == 0:
        raise InputError(f"{path} is empty")
    with open(path, "rb") as f:
        head = f.read(1 << 20)
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8"
    for e in ENCODINGS:
        try:
            head[: len(head) - 4].decode(e) if len(head) == 1 << 20 else head.decode(e)
            return "utf-8" if e == "utf-8-sig" else e
        except UnicodeDecodeError:
            continue
    return "iso-8859-1"


def null_missing(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as text, missing values as null; quoted line breaks are read, an unclosed quote is an error on use."""
    raw = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", _encoding(path))
        .option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    if not raw.columns:
        raise InputError(f"{path} has no columns")
    return null_missing(raw)


def sheet_names(path: str) -> list[str]:
    with _workbook(path) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet")]


def _workbook(path: str) -> zipfile.ZipFile:
    try:
        return zipfile.ZipFile(path)
    except (zipfile.BadZipFile, OSError) as e:
        raise InputError(f"{path} is no workbook: {e}") from e


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """One sheet of an .xlsx file, all cells as text; a workbook is bounded by its format to about a million rows."""
    with _workbook(path) as z:
        try:
            book = ElementTree.fromstring(z.read("xl/workbook.xml"))
            rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        except (KeyError, ElementTree.ParseError) as e:
            raise InputError(f"{path} is damaged: {e}") from e
        sheets = {s.get("name"): rels[s.get(_REL)] for s in book.iter(f"{{{_NS['m']}}}sheet")}
        if sheet is not None and sheet not in sheets:
            raise InputError(f"{path} has no sheet {sheet!r}; it has {list(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        rows = []
        for row in ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/"))).iter(f"{{{_NS['m']}}}row"):
            cells: dict[int, str] = {}
            for c in row.findall("m:c", _NS):
                v, kind = c.find("m:v", _NS), c.get("t")
                text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else v.text if v is not None else None
                if text is not None:
                    cells[_column(c.get("r"))] = shared[int(text)] if kind == "s" else text
            rows.append(cells)
    if not rows or not rows[0]:
        raise InputError(f"{path} is empty")
    header = [rows[0].get(i, f"column_{i}") for i in range(max(rows[0]) + 1)]
    data = [tuple(r.get(i) for i in range(len(header))) for r in rows[1:] if r]
    schema = ", ".join(f"`{h}` string" for h in header)
    return null_missing(spark.createDataFrame(data, schema))


def load(spark: SparkSession, source: str | bytes, file_name: str | None = None, sheet: str | None = None) -> DataFrame:
    """Reads a path or uploaded bytes by the suffix of its name; inputs without rows or columns are errors."""
    name = file_name or (source if isinstance(source, str) else "")
    suffix = Path(name).suffix.lower()
    if suffix not in (".csv", ".xlsx"):
        raise InputError(f"unsupported file format: {suffix or name!r}")
    if isinstance(source, bytes):
        if not source:
            raise InputError("the upload is empty")
        with tempfile.NamedTemporaryFile(suffix=suffix, delete=False) as f:  # uploads are small and read on the driver's machine
            f.write(source)
            source = f.name
    df = read_csv(spark, source) if suffix == ".csv" else read_workbook(spark, source, sheet)
    if df.isEmpty():
        raise InputError(f"{name} has no rows")
    return df


def columns_of(spark: SparkSession, source: str, sheet: str | None = None) -> list[str]:
    return (read_csv(spark, source) if source.lower().endswith(".csv") else read_workbook(spark, source, sheet)).columns


def fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, size): of each file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def json_dictionary(path: str) -> dict[str, str]:
    """A JSON object with lower-case keys and values; missing or malformed files give none."""
    try:
        got = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return {str(k).lower(): str(v).lower() for k, v in got.items()} if isinstance(got, dict) else {}


def yaml_aliases(path: str) -> list[str]:
    """The list under ``aliases``; missing or malformed files give the keyword column alone."""
    try:
        import yaml

        got = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        names = [str(a).lower() for a in got["aliases"]]
    except Exception:  # noqa: BLE001
        return ["keyword"]
    return names or ["keyword"]
