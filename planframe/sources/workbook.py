"""Workbooks (XLSX). A file holds 1,048,576 rows a sheet at most, so one task reads one and the driver may write one."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import values as V
from ..sheet import PlanError, Sheet, safe_name
from .delimited import clean_header

MOST_ROWS = 1_048_575
#: Numbers of built-in formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_CELLS = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _texts(element) -> str:
    """Text of a string item without its phonetic runs."""
    return "".join("".join(t.text or "" for t in part.iter() if _local(t.tag) == "t") for part in element if _local(part.tag) in ("t", "r"))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles whose number format shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(e.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode") or "") for e in root.iter() if _local(e.tag) == "numFmt"}
    out = set()
    for group in (e for e in root if _local(e.tag) == "cellXfs"):
        for i, style in enumerate(group):
            number = int(style.get("numFmtId") or 0)
            if number in DATE_FORMATS or re.search(r"[dmyhs]", custom.get(number, ""), re.I) and "general" not in custom[number].lower():
                out.add(i)
    return out


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and paths of the sheets, in order."""
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _local(e.tag) == "sheet":
            target = targets[next(v for k, v in e.attrib.items() if _local(k) == "id" and k != "id")]
            out.append((e.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _column(reference: str) -> int:
    at = 0
    for letter in re.match(r"[A-Z]+", reference)[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def rows_of(content: bytes):
    """(sheet number, sheet, row number, cells) of every row with a value; a cell is (kind, text), kind n, d, b or s."""
    book = zipfile.ZipFile(io.BytesIO(content))
    dates, strings = _date_styles(book), []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, e in ElementTree.iterparse(f):
                if _local(e.tag) == "si":
                    strings.append(_texts(e))
                    e.clear()
    for number, (name, path) in enumerate(_sheets(book)):
        at = 0
        with book.open(path) as f:
            for _, e in ElementTree.iterparse(f):
                if _local(e.tag) != "row":
                    continue
                at = int(e.get("r") or at + 1)
                cells: list = []
                for c in e:
                    place = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [None] * (place + 1 - len(cells))
                    value = next((x.text for x in c if _local(x.tag) == "v"), None)
                    kind = c.get("t") or "n"
                    if kind == "inlineStr":
                        value = "".join(_texts(x) for x in c if _local(x.tag) == "is")
                    elif kind == "s" and value is not None:
                        value = strings[int(value)]
                    if value is None or kind == "e" or not value.strip():
                        continue
                    if kind == "n" and int(c.get("s") or 0) in dates:
                        whole = datetime.datetime(1899, 12, 30) + datetime.timedelta(seconds=round(float(value) * 86400))
                        cells[place] = {"k": "d", "v": whole.isoformat(sep=" ")}
                    else:
                        cells[place] = {"k": kind if kind in "nb" else "s", "v": value}
                e.clear()
                if any(cells):
                    yield number, name, at, cells


def read_workbook(spark: SparkSession, path: str) -> dict[str, Sheet]:
    """Each sheet: the first row with a value is its header; a column is a number, date or boolean where all its cells are."""

    def unpack(batches):
        for batch in batches:
            for content in batch.column(0):
                held = []
                for row in rows_of(content.as_py()):
                    held.append(row)
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["n", "sheet", "at", "cells"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], ["n", "sheet", "at", "cells"])

    kinds = [pa.int32(), pa.string(), pa.int64(), _CELLS]
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "n int, sheet string, at long, cells array<struct<k: string, v: string>>")
    heads = found.groupBy("n", "sheet").agg(F.min_by("cells", "at").alias("head"), F.min("at").alias("first"), F.max(F.size("cells")).alias("width")).orderBy("n").collect()  # a row a sheet
    out = {}
    for head in heads:
        width = head["width"]
        names = clean_header([c["v"] if c else None for c in head["head"]] + [None] * (width - len(head["head"])))
        body = found.filter((F.col("n") == head["n"]) & (F.col("at") > head["first"]))
        cells = [F.get("cells", F.lit(i)) for i in range(width)]
        told = body.agg(*[F.collect_set(c["k"]).alias(f"k{i}") for i, c in enumerate(cells)], *[F.bool_or((c["k"] == "n") & c["v"].rlike("[.eE]")).alias(f"f{i}") for i, c in enumerate(cells)], *[F.bool_or((c["k"] == "d") & ~c["v"].endswith("00:00:00")).alias(f"t{i}") for i, c in enumerate(cells)]).first()
        columns = []
        for i, (name, cell) in enumerate(zip(names, cells)):
            only = told[f"k{i}"][0] if len(told[f"k{i}"]) == 1 else "s"
            kind = {"n": "double" if told[f"f{i}"] else "bigint", "d": "timestamp_ntz" if told[f"t{i}"] else "date", "b": "boolean", "s": "string"}[only]
            columns.append(cell["v"].cast(kind).alias(name))
        out[head["sheet"]] = Sheet(body.select(*columns, F.col("at").alias("__o0")), [("__o0", True)])
    return out


#: Parts of a workbook, and its styles: plain, bold header, date, and what number formats ask for.
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_SHEET_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
FORMATS = {"rupees": '[>=10000000]"₹"##\\,##\\,##\\,##0.00;[>=100000]"₹"##\\,##\\,##0.00;"₹"#,##0.00', "commas": "#,##0.00", "percent": '0.00"%"'}
DATE_FORMAT = "dd/mm/yyyy"


def format_code(given: dict) -> str | None:
    """The number format of a column: its style with its decimals or date pattern."""
    style = given.get("style")
    if style == "date":
        return given.get("date_pattern") or DATE_FORMAT
    if style == "decimals":
        places = 2 if given.get("decimals") is None else int(given["decimals"])
        return "#,##0" + ("." + "0" * places if places else "")
    return FORMATS.get(style)



#: Fills of highlights.
COLORS = {
    "yellow": "FFF2CC", "red": "F4CCCC", "green": "D9EAD3", "blue": "CFE2F3", "orange": "FCE5CD", "purple": "D9D2E9", "pink": "F8D7E3", "grey": "E7E6E6",
    "dark yellow": "FFD966", "dark red": "E06666", "dark green": "93C47D", "dark blue": "6FA8DC", "dark orange": "F6B26B", "dark purple": "8E7CC3", "dark pink": "E48FB0", "dark grey": "B7B7B7",
}


def _letters(at: int) -> str:
    out = ""
    while at >= 0:
        out, at = chr(65 + at % 26) + out, at // 26 - 1
    return out


def _cell(place: str, value, style: int, fill: int = 0) -> str:
    """One cell; ``fill`` is what a highlight adds to the number of its style."""
    mark = f' s="{style + fill}"' if style + fill else ""
    if value is None or value != value:
        return f'<c r="{place}"{mark}/>' if fill else ""
    if isinstance(value, bool):
        return f'<c r="{place}"{mark} t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (datetime.date, datetime.datetime)):
        moment = value if isinstance(value, datetime.datetime) else datetime.datetime.combine(value, datetime.time())
        return f'<c r="{place}" s="{(style or 2) + fill}"><v>{(moment.replace(tzinfo=None) - datetime.datetime(1899, 12, 30)).total_seconds() / 86400:.10g}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{place}"{mark}><v>{value!r}</v></c>'
    bare = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", str(value))
    return f'<c r="{place}"{mark} t="inlineStr"><is><t xml:space="preserve">{escape(bare)}</t></is></c>'


def write_workbook(sheets: Sheet | dict[str, Sheet], path: str, name: str = "Sheet1") -> list[str]:
    """Writes a workbook, a sheet for each name and value of a split; returns the sheet names. Refused beyond the rows of a sheet.

    Rows come to the driver one partition at a time and go straight into the file. Highlighted rows or cells are filled.
    """
    sheets = {name: sheets} if isinstance(sheets, Sheet) else sheets
    planned = []
    for title, sheet in sheets.items():
        sizes = sorted(sheet.df.groupBy(*sheet.split).count().limit(257).collect())
        if any(r["count"] > MOST_ROWS for r in sizes):
            raise PlanError(f"a sheet holds {MOST_ROWS:,} rows at most: write delimited text instead")
        planned += [(title, sheet, [row[m] for m in sheet.split]) for row in sizes or [None] if row or not sheet.split]
    if len(planned) > 256:
        raise PlanError("a workbook holds 256 sheets at most: write delimited text instead")
    used = [code for s in sheets.values() for f in s.formats.values() if (code := format_code(f))]
    styles = list(dict.fromkeys([DATE_FORMAT, *FORMATS.values(), "#,##0", *used]))
    fills = list(dict.fromkeys(f["highlight"] for s in sheets.values() for f in s.formats.values() if "highlight" in f))
    if unknown := [c for c in fills if c not in COLORS]:
        raise PlanError(f"there is no colour {unknown[0]!r}; the colours are {', '.join(COLORS)}")
    each = 2 + len(styles)  # styles without a fill, then as many for each fill
    names, taken = [], set()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        for title, sheet, values in planned:
            part = sheet.df
            for m, v in zip(sheet.split, values):
                part = part.filter(F.col(m) == F.lit(v))
            names.append(safe_name("-".join(map(str, values)) or title, taken))
            columns, marks = sheet.columns, [(m, f) for m, f in sheet.formats.items() if "highlight" in f]
            of_column = [2 + styles.index(code) if (code := format_code(sheet.formats.get(c, {}))) else 0 for c in columns]
            marked = [(len(columns) + k, (fills.index(f["highlight"]) + 1) * each, [i for i, c in enumerate(columns) if f.get("column") in (None, c)]) for k, (m, f) in enumerate(marks)]
            shown = part.orderBy(*sheet.by_order()) if sheet.order else part
            shown = shown.select(*[V.col(c) for c in columns], *[F.col(m) for m, _ in marks])
            widths = _widths(shown, columns)
            with book.open(f"xl/worksheets/sheet{len(names)}.xml", "w") as raw, io.TextIOWrapper(raw, "utf-8") as f:
                f.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>')
                f.write("<cols>" + "".join(f'<col min="{i + 1}" max="{i + 1}" width="{min(50, w + 2)}" customWidth="1"/>' for i, w in enumerate(widths)) + "</cols><sheetData>" if widths else "<sheetData>")
                f.write('<row r="1">' + "".join(_cell(f"{_letters(i)}1", c, 1) for i, c in enumerate(columns)) + "</row>")
                for n, r in enumerate(shown.toLocalIterator(), 2):
                    filled = {i: fill for at, fill, where in marked if r[at] for i in where}
                    f.write(f'<row r="{n}">' + "".join(_cell(f"{_letters(i)}{n}", r[i], of_column[i], filled.get(i, 0)) for i in range(len(columns))) + "</row>")
                f.write("</sheetData></worksheet>")
        book.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        book.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + f'<Relationship Id="rId{len(names) + 1}" Type="{_DOC}/styles" Target="styles.xml"/></Relationships>')
        numbers = "".join(f'<numFmt numFmtId="{170 + i}" formatCode={quoteattr(s)}/>' for i, s in enumerate(styles))
        # fills 0 and 1 are kept by the format for itself
        colours = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>' + "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{COLORS[c]}"/></patternFill></fill>' for c in fills)
        cells = ""
        for k in range(len(fills) + 1):
            fill = f' fillId="{k + 1}" applyFill="1"' if k else ""
            cells += f'<xf numFmtId="0" fontId="0"{fill}/><xf numFmtId="0" fontId="1" applyFont="1"{fill}/>' + "".join(f'<xf numFmtId="{170 + i}" fontId="0" applyNumberFormat="1"{fill}/>' for i in range(len(styles)))
        book.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="{len(styles)}">{numbers}</numFmts><fonts count="2"><font/><font><b/></font></fonts><fills count="{2 + len(fills)}">{colours}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{each * (len(fills) + 1)}">{cells}</cellXfs></styleSheet>')
        book.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_SHEET_TYPE}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        book.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{_SHEET_TYPE}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_SHEET_TYPE}.styles+xml"/>{parts}</Types>')
    return names


def _widths(shown, columns: list[str]) -> list[int]:
    """Widest of the header and the first 1,000 rows."""
    rows = shown.limit(1000).collect()
    return [max([len(c), *(len(str(r[i])) for r in rows if r[i] is not None)]) for i, c in enumerate(columns)]
