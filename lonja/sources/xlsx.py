"""Workbooks: reading every sheet as text rows, writing text sheets.

Reading goes through Spark's binary file source, so paths may be on any file system Spark reads; one task parses a file
and hands out rows in Arrow batches. The first pass reads header rows alone to find the columns. ``_ord`` orders rows by
file (sorted path), sheet and row, without a shuffle.

Writing is an ordered single-writer sink on the driver that pulls one partition at a time; the file appears under its
name only when it is whole. For parallel output write CSV or Parquet parts instead.
"""

from __future__ import annotations

import io
import math
import os
import re
import tempfile
import warnings
import zipfile
from collections.abc import Iterable, Iterator, Sequence
from decimal import Decimal
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.operators.align import align, header_names, union_columns

#: Limits of the format and of what is opened (fixed values).
MAX_ROWS, MAX_COLUMNS = 1_048_576, 16_384
MAX_UNPACKED, MAX_ENTRIES = 512 * 1024 * 1024, 50_000
_SHEET_BITS, _ROW_BITS = 12, 21
_BATCH = 20_000


def number_text(value: float) -> str:
    """Whole numbers below 1e15 as integers, others as the shortest decimal, never with an exponent."""
    if math.isfinite(value) and value == int(value) and abs(value) < 1e15:
        return str(int(value))
    return format(Decimal(repr(value)), "f").removesuffix(".0") if math.isfinite(value) else repr(value)


def column_index(reference: str) -> int | None:
    """0-based column of a reference such as BC12; None if it has no letters or lies beyond the sheet."""
    letters = re.match(r"[A-Za-z]+", reference)
    if not letters:
        return None
    index = 0
    for c in letters[0].upper():
        index = index * 26 + ord(c) - 64
        if index > MAX_COLUMNS:
            return None
    return index - 1


def column_letters(index: int) -> str:
    letters = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


class Workbook:
    """A workbook in bytes; refuses archives that unpack to too much."""

    def __init__(self, content: bytes, max_unpacked: int = MAX_UNPACKED, max_entries: int = MAX_ENTRIES):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        entries = self.zip.infolist()
        if len(entries) > max_entries or sum(e.file_size for e in entries) > max_unpacked:
            raise ValueError("the workbook unpacks to more than is allowed")
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets: list[tuple[str, str]] = []
        for sheet in root.iter():
            if _local(sheet.tag) == "sheet":
                target = links.get(next((v for k, v in sheet.attrib.items() if _local(k) == "id"), None), "")
                self.sheets.append((sheet.get("name", ""), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
        self._shared: list[str] | None = None

    def shared(self) -> list[str]:
        if self._shared is None:
            self._shared = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                for _, item in ElementTree.iterparse(self.zip.open("xl/sharedStrings.xml")):
                    if _local(item.tag) == "si":
                        self._shared.append(_rich_text(item))
                        item.clear()
        return self._shared

    def rows(self, part: str) -> Iterator[list[str | None]]:
        """Rows of a sheet with gaps filled; trailing missing rows are not made up."""
        expected = 1
        for _, row in ElementTree.iterparse(self.zip.open(part)):
            if _local(row.tag) != "row":
                continue
            number = int(row.get("r", expected))
            for _ in range(number - expected):
                yield []
            cells: list[str | None] = []
            for cell in row:
                if _local(cell.tag) != "c":
                    continue
                at = column_index(cell.get("r", "")) if cell.get("r") else len(cells)
                if at is None:
                    continue
                cells += [None] * (at + 1 - len(cells))
                cells[at] = self._text(cell)
            yield cells
            row.clear()
            expected = number + 1

    def _text(self, cell: ElementTree.Element) -> str | None:
        kind = cell.get("t", "n")
        if kind == "inlineStr":
            return next((_rich_text(x) for x in cell if _local(x.tag) == "is"), None)
        value = next((x.text for x in cell if _local(x.tag) == "v"), None)
        if value is None:
            return None
        if kind == "s":
            return self.shared()[int(value)]
        if kind == "b":
            return "TRUE" if value.strip() in ("1", "true") else "FALSE"
        if kind == "n":
            return number_text(float(value))
        return value


def _rich_text(item: ElementTree.Element) -> str:
    """Text of all runs, without phonetic ones."""
    text = ""
    for child in item:
        name = _local(child.tag)
        if name == "t":
            text += child.text or ""
        elif name == "r":
            text += "".join(t.text or "" for t in child if _local(t.tag) == "t")
    return text


def _excluded(name: str, exclude: Sequence[str]) -> bool:
    return name.strip().lower() in {x.strip().lower() for x in exclude}


def _pick_sheets(book: Workbook, exclude: Sequence[str], only: str | None) -> Iterator[tuple[int, str, str]]:
    for i, (name, part) in enumerate(book.sheets):
        if not _excluded(name, exclude) and (only is None or name == only):
            yield i, name, part


def list_files(spark: SparkSession, paths: str | Sequence[str], extensions: Sequence[str] = ("xlsx",)) -> list[str]:
    """Files of the given extensions, any case, sorted by path. Contents are not read."""
    pattern = "|".join(re.escape(e) for e in extensions)
    found = spark.read.format("binaryFile").load(paths).select("path").where(F.col("path").rlike(f"(?i)\\.({pattern})$"))
    return sorted(r[0] for r in found.collect())


def _files(spark: SparkSession, files: list[str]) -> DataFrame:
    places = F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (f, i)])
    return spark.read.format("binaryFile").load(files).select("path", places[F.col("path")].alias("file"), "content")


def catalogue(spark: SparkSession, paths: str | Sequence[str], exclude: Sequence[str] = (), sheet: str | None = None) -> DataFrame:
    """``(file, path, sheet_no, sheet, columns, rows, error)`` of each sheet; an unreadable book is one row with its error."""
    files = list_files(spark, paths)
    schema = "file int, path string, sheet_no int, sheet string, columns array<string>, rows long, error string"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, file, content in zip(*(batch.column(c).to_pylist() for c in ("path", "file", "content")), strict=True):
                try:
                    book = Workbook(content)
                    for i, name, part in _pick_sheets(book, exclude, sheet):
                        try:
                            cells = book.rows(part)
                            header = next(cells, [])
                            rows.append((file, path, i, name, header_names(header), sum(1 for _ in cells), None))
                        except Exception as error:  # noqa: BLE001  whatever a damaged sheet raises becomes a warning
                            rows.append((file, path, i, name, None, None, str(error)))
                except Exception as error:  # noqa: BLE001
                    rows.append((file, path, None, None, None, None, str(error)))
            kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string())
            names = ["file", "path", "sheet_no", "sheet", "columns", "rows", "error"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return _files(spark, files).mapInArrow(run, schema)


def _warn(found: Iterable) -> None:
    for row in found:
        if row["error"]:
            warnings.warn(f"{row['path']} {row['sheet'] or ''}: {row['error']}; skipped", stacklevel=3)


def read_xlsx(spark: SparkSession, paths: str | Sequence[str], exclude: Sequence[str] = (), sheet: str | None = None, header: bool = True) -> DataFrame:
    """Text rows of all sheets under the union of their columns, with ``_file``, ``_sheet`` and ``_ord``.

    Unreadable books and sheets are skipped with a warning. Short rows are filled with nulls. With ``header=False`` the
    first row is data and columns are numbered.
    """
    found = catalogue(spark, paths, exclude, sheet).orderBy("file", "sheet_no").collect()
    _warn(found)
    files = list_files(spark, paths)
    if header:
        columns = union_columns([r["columns"] for r in found if r["columns"]])
    else:
        columns = header_names([None] * max((len(r["columns"]) for r in found if r["columns"]), default=0))
    schema = ", ".join([*[f"`{c.replace('`', '``')}` string" for c in columns], "_file string", "_sheet string", "_ord long"])
    if not files or not columns:
        return spark.createDataFrame([], schema)
    names = [*columns, "_file", "_sheet", "_ord"]
    kinds = [*[pa.string()] * (len(columns) + 2), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, file, content in zip(*(batch.column(c).to_pylist() for c in ("path", "file", "content")), strict=True):
                try:
                    book = Workbook(content)
                except Exception:  # noqa: BLE001  the catalogue has warned of it
                    continue
                for i, name, part in _pick_sheets(book, exclude, sheet):
                    held: list[list] = []
                    try:
                        cells = book.rows(part)
                        places = [columns.index(c) for c in header_names(next(cells, []))] if header else list(range(len(columns)))
                        for number, row in enumerate(cells):
                            out: list = [None] * len(columns)
                            for at, value in zip(places, row, strict=False):
                                out[at] = value
                            held.append([*out, path, name, (((file << _SHEET_BITS) | i) << _ROW_BITS) | number])
                            if len(held) >= _BATCH:
                                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                                held = []
                    except Exception:  # noqa: BLE001
                        continue
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return _files(spark, files).mapInArrow(run, schema)


def read_words(spark: SparkSession, paths: str | Sequence[str], exclude: Sequence[str] = (), header_is_word: bool = False) -> DataFrame:
    """``(word, _ord)`` from the first column of every sheet: trimmed, blank ones left out.

    The header counts as a word if asked, unless it is one of the made-up names.
    """
    rows = read_xlsx(spark, paths, exclude, header=False)
    word = F.trim(F.col(f"`{rows.columns[0]}`"))
    first = F.col("_ord").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) == 0
    kept = ~first | (F.lit(header_is_word) & ~word.rlike(r"^Columna_[0-9]+\z"))
    # Without a header every row is data, so the row that would be one is row 0 of each sheet; it is read as data here.
    return rows.where(kept & (word != "")).select(word.alias("word"), "_ord")


def sample_rows(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("_ord").limit(n)


def total_rows(spark: SparkSession, paths: str | Sequence[str], exclude: Sequence[str] = ()) -> int | None:
    """Data rows of all sheets, None if there are none."""
    return catalogue(spark, paths, exclude).agg(F.sum("rows")).first()[0] or None


# Writing


def _clean(text: str) -> str:
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def cell_xml(row: int, column: int, text: str | None) -> str:
    if text is None or text == "":
        return ""
    keep = ' xml:space="preserve"' if text != text.strip() else ""
    return f'<c r="{column_letters(column)}{row}" t="inlineStr"><is><t{keep}>{_clean(text)}</t></is></c>'


def row_xml(row: int, values: Iterable[str | None]) -> str:
    return f'<row r="{row}">{"".join(cell_xml(row, i, v) for i, v in enumerate(values))}</row>'


def sheet_name(name: str, taken: set[str]) -> str:
    """At most 31 characters without []:*?/\\ and controls, distinct without regard to case."""
    base = (re.sub(r"[\[\]:*?/\\\x00-\x1f]", "_", name).strip("'") or "Hoja")[:31]
    shown, k = base, 1
    while shown.lower() in taken:
        k += 1
        shown = base[: 31 - len(str(k)) - 1] + f"_{k}"
    taken.add(shown.lower())
    return shown


def unique_path(path: str) -> str:
    """The path, or ``name(N).ext`` with the first N that is free."""
    stem, extension = os.path.splitext(path)
    shown, k = path, 0
    while os.path.exists(shown):
        k += 1
        shown = f"{stem}({k}){extension}"
    return shown


class XlsxWriter:
    """Appends blocks of text rows to named sheets; ``close`` puts the file in place, ``abort`` leaves nothing."""

    def __init__(self, path: str, rows_per_sheet: int = 1_000_000, overwrite: bool = False):
        self.path = path if overwrite else unique_path(path)
        self.rows_per_sheet = max(1, min(rows_per_sheet, MAX_ROWS - 1))
        self.sheets: list[tuple[str, tempfile.SpooledTemporaryFile]] = []
        self.open: dict[str, dict] = {}
        self.taken: set[str] = set()
        self.total, self.done = 0, False
        #: Package types, and what stands before and after the rows of each sheet.
        self.types = self.before = self.after = ""

    def _start(self, base: str, columns: list[str]) -> dict:
        state = self.open.setdefault(base, {"columns": columns, "parts": 0, "blanks": 0})
        state["parts"] += 1
        name = base if state["parts"] == 1 else f"{base[:28]}_{state['parts']}"
        spool = tempfile.SpooledTemporaryFile(max_size=64 * 1024 * 1024)  # noqa: SIM115
        self.sheets.append((sheet_name(name, self.taken), spool))
        state |= {"spool": spool, "row": 1}
        spool.write(row_xml(1, state["columns"]).encode())
        return state

    def _put(self, base: str, values: list[str | None]) -> None:
        state = self.open[base]
        if state["row"] > self.rows_per_sheet:
            state = self._start(base, state["columns"])
        state["row"] += 1
        state["spool"].write(row_xml(state["row"], values).encode())
        self.total += 1

    def write(self, columns: list[str], rows: Iterable[Sequence[str | None]], base: str = "Hoja1") -> None:
        """Rows are aligned to the sheet's first block. Blank rows wait until a row with a value follows."""
        state = self.open.get(base) or self._start(base, columns)
        at = [columns.index(c) if c in columns else None for c in state["columns"]]
        extra = [c for c in columns if c not in state["columns"]]
        if extra:
            warnings.warn(f"columns not in the first block of {base!r} are left out: {', '.join(extra)}", stacklevel=2)
        for row in rows:
            values = [None if i is None else row[i] for i in at]
            if not any(values):
                state["blanks"] += 1
                continue
            for _ in range(state["blanks"]):
                self._put(base, [None] * len(values))
            state["blanks"] = 0
            self._put(base, values)

    def close(self) -> str:
        if self.done:
            return self.path
        if not self.sheets:
            self._start("Hoja1", [])
        folder = os.path.dirname(os.path.abspath(self.path))
        handle, temporary = tempfile.mkstemp(suffix=".part", dir=folder)
        os.close(handle)
        try:
            with zipfile.ZipFile(temporary, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as out:
                self._package(out)
            os.replace(temporary, self.path)
        except BaseException:
            os.unlink(temporary)
            raise
        finally:
            self.done = True
        return self.path

    def abort(self) -> None:
        self.done = True
        for _, spool in self.sheets:
            spool.close()

    def _package(self, out: zipfile.ZipFile) -> None:
        main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package, kinds = "http://schemas.openxmlformats.org/package/2006", "application/vnd.openxmlformats-officedocument.spreadsheetml"
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        numbers = range(1, len(self.sheets) + 1)
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in numbers)
        out.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>{parts}{self.types}</Types>')
        out.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{_clean(name).replace(chr(34), "&quot;")}" sheetId="{i}" r:id="rId{i}"/>' for i, (name, _) in enumerate(self.sheets, 1))
        out.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{office}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers)
        out.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships">{links}</Relationships>')
        for i, (_, spool) in enumerate(self.sheets, 1):
            with out.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as part:
                part.write(f'{head}<worksheet xmlns="{main}">{self.before}<sheetData>'.encode())
                spool.seek(0)
                while block := spool.read(1 << 20):
                    part.write(block)
                part.write(f"</sheetData>{self.after}</worksheet>".encode())


def write_xlsx(routes: DataFrame | dict[str, DataFrame], path: str, rows_per_sheet: int = 1_000_000, order: str = "_ord", overwrite: bool = False) -> str:
    """One sheet (or numbered sheets) for each route in order of ``order``; returns the path written. A failure leaves no file."""
    writer = XlsxWriter(path, rows_per_sheet, overwrite)
    try:
        for base, frame in (routes if isinstance(routes, dict) else {"Hoja1": routes}).items():
            ordered = frame.orderBy(order) if order in frame.columns else frame
            columns = [c for c in frame.columns if not c.startswith("_")]
            text = align(ordered, columns)
            writer.write(columns, (tuple(r) for r in text.toLocalIterator(prefetchPartitions=True)), base)
        return writer.close()
    except BaseException:
        writer.abort()
        raise
