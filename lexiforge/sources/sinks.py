"""Writers: CSV views, workbooks, JSON reports."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

MAX_SHEET_ROWS = 1_048_575


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with header; one file only where a report asks for it."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def _sheet(rows: list[tuple]) -> str:
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
        return f"<c><v>{v}</v></c>"

    body = "".join(f'<row r="{n}">{"".join(_with_ref(cell(v), k, n) for k, v in enumerate(r))}</row>' for n, r in enumerate(rows, 1))
    return f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def _with_ref(xml: str, column: int, row: int) -> str:
    name, n = "", column + 1
    while n:
        n, r = divmod(n - 1, 26)
        name = chr(65 + r) + name
    return xml.replace("<c", f'<c r="{name}{row}"', 1)


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """Sheets of an .xlsx file; a sheet holds at most what the format allows, more is an error."""
    files = {}
    for k, (_, df) in enumerate(sheets.items(), 1):
        rows = df.limit(MAX_SHEET_ROWS + 1).collect()
        if len(rows) > MAX_SHEET_ROWS:
            raise ValueError("a sheet can't hold so many rows; write CSV")
        files[f"xl/worksheets/sheet{k}.xml"] = _sheet([tuple(df.columns), *map(tuple, rows)])
    names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    rels = "".join(
        f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>'
        for k in range(1, len(sheets) + 1)
    )
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml",
            f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>',
        )
        z.writestr(
            "_rels/.rels",
            f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        )
        z.writestr(
            "xl/workbook.xml",
            f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>',
        )
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>')
        for name, xml in files.items():
            z.writestr(name, xml)


def write_json(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=2, default=str, ensure_ascii=False), encoding="utf-8")
