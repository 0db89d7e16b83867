"""Files to text: format dispatch, CSV, workbooks, decoding, HTML; every reader is a DataFrame of (path, content) or Spark's own."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Formats by extension, and by MIME type where the extension says nothing.
FORMATS = {e: e for e in ("pdf", "docx", "doc", "pptx", "xlsx", "csv", "txt", "md", "json", "log")} | {"markdown": "md", "jpg": "image", "jpeg": "image", "png": "image", "tiff": "image", "bmp": "image", "webp": "image"}
MIME = {"application/pdf": "pdf", "text/csv": "csv", "text/markdown": "md", "image/png": "image", "image/jpeg": "image", "application/json": "json"}
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "big5")
MOST_COLUMNS, MOST_CELLS = 1000, 100_000


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def format_of(filename: Column, mime: Column | None = None) -> Column:
    """The parser's name: by extension first, then by MIME type, txt otherwise."""
    ext = F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    by_mime = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.try_element_at(by_mime, F.lower(mime)) if mime is not None else F.lit(None), F.lit("txt"))


def cell(c: Column) -> Column:
    """A table cell in Markdown: pipes escaped, line ends as <br>."""
    return F.regexp_replace(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"\r\n?|\n", "<br>")


def markdown_rows(table: DataFrame) -> DataFrame:
    """table with a column `markdown`: each row as a line of a pipe table, all cells as strings."""
    return table.withColumn("markdown", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(f"`{c}`")) for c in table.columns]), F.lit(" |")))


def markdown_head(table: DataFrame) -> str:
    return "| " + " | ".join(c.replace("|", "\\|") for c in table.columns) + " |\n|" + " --- |" * len(table.columns)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All cells as strings: leading zeros and empty cells stay what they are."""
    return spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("nullValue", "\u0000").option("emptyValue", "").csv(path)


def decode(data: bytes, most_bad: float = 0.05) -> str:
    """By the first of ENCODINGS that fits, else as UTF-8 with replacements, an error if those exceed 5 per cent."""
    for name in ENCODINGS:
        try:
            text = data.decode(name)
            break
        except UnicodeDecodeError:
            continue
    else:
        text = data.decode("utf-8", errors="replace")
    if text and text.count("�") / len(text) > most_bad:
        raise ValueError("not a text in a known encoding")
    return text


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """decode(), null where it fails."""

    def one(b):
        try:
            return None if b is None else decode(bytes(b))
        except ValueError:
            return None

    return content.map(one)


def sheets(data: bytes) -> list[tuple[str, str]]:
    """(name, text) of a workbook's sheets: `Sheet: name`, then rows of cells joined by " | "; formulas stay formulas, blank rows
    go, sheets without a second row go."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", ns):
            target = targets[sheet.get(rel)]
            tree = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            rows = []
            for row in tree.findall("m:sheetData/m:row", ns):
                cells: dict[int, str] = {}
                for at, c in enumerate(row.findall("m:c", ns)):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    column = at
                    if letters:
                        column = 0
                        for x in letters[0]:
                            column = column * 26 + ord(x) - 64
                        column -= 1
                    f, v = c.find("m:f", ns), c.find("m:v", ns)
                    if f is not None and f.text:
                        cells[column] = "=" + f.text
                    elif c.get("t") == "s" and v is not None:
                        cells[column] = shared[int(v.text)]
                    elif c.get("t") == "inlineStr":
                        cells[column] = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t"))
                    elif v is not None:
                        cells[column] = v.text or ""
                line = [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
                if any(x.strip() for x in line):
                    rows.append(" | ".join(line))
            if len(rows) > 1:
                out.append((sheet.get("name"), "\n".join([f"Sheet: {sheet.get('name')}", *rows])))
    return out


def read_workbooks(files: DataFrame) -> DataFrame:
    """path, page_number, sheet, text, char_start, char_end of (path, content) rows; pages are two characters apart."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                at = 0
                for n, (name, text) in enumerate(sheets(bytes(content)), 1):
                    rows.append((path, n, name, text, at, at + len(text)))
                    at += len(text) + 2
            yield pd.DataFrame(rows, columns=["path", "page_number", "sheet", "text", "char_start", "char_end"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, sheet string, text string, char_start int, char_end int")


BLOCKS = frozenset("address article aside blockquote br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
SKIPPED = frozenset(("script", "style", "noscript", "svg"))


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.title, self.skip, self.in_title = [], [], 0, False

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if not self.skip:
            (self.title if self.in_title else self.parts).append(data)


def html_text(html: str) -> tuple[str, str]:
    """(title, text): scripts and styles left out, blocks on lines of their own, white space collapsed."""
    r = _Reader()
    r.feed(html)
    r.close()
    lines = (re.sub(r"\s+", " ", s).strip() for s in "".join(r.parts).split("\n"))
    return re.sub(r"\s+", " ", "".join(r.title)).strip(), "\n".join(s for s in lines if s)


@F.pandas_udf(T.StructType([T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
def page_text(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([html_text(h or "") for h in html], columns=["title", "text"])


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.row = []
            self.tables[-1].append(self.row)
        elif tag == "br":
            self.handle_data(" ")
        elif tag in ("td", "th") and self.row is not None:
            span = lambda k: int(a[k]) if (a.get(k) or "").isdigit() else 1
            self.cell = [span("rowspan"), span("colspan"), ""]
            self.row.append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None
        elif tag == "tr":
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[2] += data


def _grid(rows: list) -> dict[tuple[int, int], str]:
    """(row, column) -> text of a table's rows, cells that span rows or columns repeated."""
    grid: dict[tuple[int, int], str] = {}
    for y, row in enumerate(rows):
        x = 0
        for down, across, text in row:
            while (y, x) in grid:
                x += 1
            down, across = len(rows) - y if down == 0 else min(down, len(rows) - y), max(1, across)
            if x + across > MOST_COLUMNS or len(grid) + down * across > MOST_CELLS:
                raise ValueError("table too large")
            value = re.sub(r"\s+", " ", text).strip()
            for i in range(y, y + down):
                for j in range(x, x + across):
                    if (i, j) in grid:
                        raise ValueError("overlapping spans")
                    grid[i, j] = value
            x += across
    return grid


def table_markdown(html: str) -> str:
    """The first table as Markdown; cells that span rows or columns are repeated. Overlapping spans, more than 1000 columns or
    100,000 cells are errors; a row span of 0 reaches the last row."""
    p = _Tables()
    p.feed(html)
    if not p.tables:
        return ""
    rows, grid = p.tables[0], _grid(p.tables[0])
    width = max((x for _, x in grid), default=-1) + 1
    cell = lambda y, x: grid.get((y, x), "").replace("|", "\\|")
    lines = ["| " + " | ".join(cell(y, x) for x in range(width)) + " |" for y in range(len(rows))]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) if lines and width else ""


@F.udtf(returnType="table int, row int, col int, text string, error string")
class TableCells:
    """A row for each cell of the grids of an HTML text's tables, all from 0, to be joined laterally. Cells that span rows or columns
    have a row for each place they cover. A table that is too large or whose spans overlap has one row, with the error."""

    def eval(self, html: str):
        if html:
            p = _Tables()
            p.feed(html)
            for n, rows in enumerate(p.tables):
                try:
                    for (y, x), text in sorted(_grid(rows).items()):
                        yield n, y, x, text, None
                except ValueError as e:
                    yield n, None, None, None, str(e)
