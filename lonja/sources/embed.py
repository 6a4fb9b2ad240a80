"""Workbooks that show their images: each URL column is followed by as many columns as its fullest cell has URLs.

Images are fetched, decoded and made small on the executors; the workbook, one file, is put together by the driver row by
row, spooled to disk.
"""

from __future__ import annotations

import struct
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions.ocr import resize
from lonja.functions.pixels import BadImage, decode
from lonja.operators.cells import embed_tasks
from lonja.sources.fetch import FetchOptions, fetched
from lonja.sources.xlsx import XlsxWriter

# Sizes in pixels, the most columns of a sheet, and the text of a failed image are fixed values.
WIDTH, HEIGHT, MAX_COLUMNS, FAILED = 118, 168, 16_384, "Error"
_PIXEL = 9525  # drawing units


def pixels_to_points(pixels: float) -> float:
    """Row height."""
    return pixels * 0.75


def pixels_to_width(pixels: float) -> float:
    """Column width, in characters of the default font."""
    return pixels / 7


def encode_png(rgb: np.ndarray) -> bytes:
    def chunk(name: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    lines = np.pad(rgb.reshape(len(rgb), -1), ((0, 0), (1, 0))).tobytes()
    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def small_images(tasks: DataFrame, options: FetchOptions = FetchOptions()) -> DataFrame:
    """``tasks(idx, col, slot, url)`` to ``idx, col, slot, image``: a PNG of fixed size, null where there is none."""

    def small(content: bytes | None) -> bytes | None:
        try:
            return None if content is None else encode_png(resize(decode(content), HEIGHT, WIDTH))
        except BadImage:
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in fetched(batches, options):
            yield group[["idx", "col", "slot"]].assign(image=[small(c) for c in group["content"]])

    return tasks.select("idx", "col", "slot", "url").mapInPandas(run, "idx long, col string, slot int, image binary")


class _Album(XlsxWriter):
    """A workbook of one sheet with pictures anchored to cells."""

    def __init__(self, path: str, wide: Sequence[int]):
        super().__init__(path)
        self.media = tempfile.SpooledTemporaryFile(max_size=64 * 1024 * 1024)  # noqa: SIM115
        self.places: list[tuple[int, int, int]] = []
        columns = "".join(f'<col min="{i + 1}" max="{i + 1}" width="{pixels_to_width(WIDTH)}" customWidth="1"/>' for i in wide)
        self.before = f'<sheetFormatPr defaultRowHeight="{pixels_to_points(HEIGHT)}" customHeight="1"/>' + (f"<cols>{columns}</cols>" if columns else "")

    def place(self, row: int, column: int, image: bytes) -> None:
        self.media.write(image)
        self.places.append((row, column, len(image)))

    def _package(self, out: zipfile.ZipFile) -> None:
        if self.places:
            self.after = '<drawing xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:id="rId1"/>'
            self.types = '<Default Extension="png" ContentType="image/png"/><Override PartName="/xl/drawings/drawing1.xml" ContentType="application/vnd.openxmlformats-officedocument.drawing+xml"/>'
        super()._package(out)
        if not self.places:
            return
        office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006/relationships"
        drawing = "http://schemas.openxmlformats.org/drawingml/2006"
        out.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/drawing" Target="../drawings/drawing1.xml"/></Relationships>')
        self.media.seek(0)
        for n, (_, _, size) in enumerate(self.places, 1):
            out.writestr(zipfile.ZipInfo(f"xl/media/img_{n}.png"), self.media.read(size))
        with out.open("xl/drawings/_rels/drawing1.xml.rels", "w") as part:
            part.write(f'<Relationships xmlns="{package}">'.encode())
            for n in range(1, len(self.places) + 1):
                part.write(f'<Relationship Id="rId{n}" Type="{office}/image" Target="../media/img_{n}.png"/>'.encode())
            part.write(b"</Relationships>")
        with out.open("xl/drawings/drawing1.xml", "w") as part:
            part.write(f'<xdr:wsDr xmlns:xdr="{drawing}/spreadsheetDrawing" xmlns:a="{drawing}/main" xmlns:r="{office}">'.encode())
            for n, (row, column, _) in enumerate(self.places, 1):
                spot = f"<xdr:from><xdr:col>{column}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from>"
                size = f'cx="{WIDTH * _PIXEL}" cy="{HEIGHT * _PIXEL}"'
                shape = f'<xdr:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></xdr:spPr>'
                names = f'<xdr:nvPicPr><xdr:cNvPr id="{n}" name="img_{n}"/><xdr:cNvPicPr/></xdr:nvPicPr>'
                fill = f'<xdr:blipFill><a:blip r:embed="rId{n}"/><a:stretch><a:fillRect/></a:stretch></xdr:blipFill>'
                part.write(f"<xdr:oneCellAnchor>{spot}<xdr:ext {size}/><xdr:pic>{names}{fill}{shape}</xdr:pic><xdr:clientData/></xdr:oneCellAnchor>".encode())
            part.write(b"</xdr:wsDr>")


def granted(wanted: dict[str, int], names: Sequence[str], limit: int = MAX_COLUMNS) -> dict[str, int]:
    """Columns inserted after each URL column, from the left, as far as the sheet's limit allows."""
    given, used = {}, 0
    for place, name in enumerate(names, 1):
        if name in wanted:
            given[name] = min(wanted[name], max(0, limit - place - used))
            used += given[name]
    return given


def write_with_images(df: DataFrame, columns: Sequence[str], path: str, options: FetchOptions = FetchOptions(), order: str = "_ord", warn: Callable[[str], None] | None = None) -> str:
    """Text cells as they are, images right of their URL column, ``Error`` in the cell of one that cannot be had.

    Inserted columns are called ``<column>_imagen_1`` and so on. Rows beyond a sheet's limit are an error. Returns the path.
    """
    names = [c for c in df.columns if not c.startswith("_")]
    tasks = embed_tasks(df, columns, order)
    wanted = {r["col"]: r["k"] for r in tasks.groupBy("col").agg((F.max("slot") + 1).alias("k")).collect()}
    given = granted(wanted, names)
    cut = sum(wanted.values()) - sum(given.values())
    if cut and warn:
        warn(f"the sheet is full: {cut} images of a row are left out")
    header, start = [], {}
    for c in names:
        header.append(c)
        start[c] = len(header)
        header += [f"{c}_imagen_{k + 1}" for k in range(given.get(c, 0))]
    images = small_images(tasks, options).groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("col", "slot", "image"))).alias("_images"))
    rows = df.join(images, F.col(order).cast("long") == F.col("idx"), "left").orderBy(order)
    album = _Album(path, [start[c] + k for c in names for k in range(given.get(c, 0))])
    try:
        album.write(header, [], "Hoja1")
        shown = rows.select(*[F.col(f"`{c}`").cast("string") for c in names], "_images")
        for number, row in enumerate(shown.toLocalIterator(prefetchPartitions=True), 1):
            if number > album.rows_per_sheet:
                raise ValueError(f"more than {album.rows_per_sheet} rows")
            values: list[str | None] = [None] * len(header)
            for i, c in enumerate(names):
                values[start[c] - 1] = row[i]
            for image in sorted(row["_images"] or [], key=lambda r: (start[r["col"]], r["slot"])):
                if image["slot"] >= given[image["col"]]:
                    continue
                at = start[image["col"]] + image["slot"]
                if image["image"] is None:
                    values[at] = FAILED
                else:
                    album.place(number, at, bytes(image["image"]))
            album.write(header, [values], "Hoja1")
        return album.close()
    except BaseException:
        album.abort()
        raise
