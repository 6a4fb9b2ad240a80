import http.server
import struct
import threading
import zipfile
import zlib
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lonja import tools
from lonja.functions import ocr, pixels
from lonja.operators import cells
from lonja.plans import images
from lonja.sources import embed
from lonja.sources.fetch import FetchOptions
from lonja.sources.xlsx import read_xlsx


def solid(h, w, colour):
    return np.full((h, w, 3), colour, np.uint8)


def test_pixel_rules():
    grey = solid(100, 100, (180, 180, 180))
    assert images.banner(grey) is images.background(grey) is images.diagram(grey) is None
    top = grey.copy()
    top[:20] = (220, 20, 20)
    assert images.banner(top) == "D1·Banner de color en zona superior (100% píxeles saturados)"
    dark = grey.copy()
    for y in (0, 80):
        for x in (0, 80):
            dark[y : y + 20, x : x + 20] = 0
    assert images.background(dark) == "D2·Fondo no neutro: 100.0% píxeles no neutros en esquinas (V_media=0, S_media=0)"
    grid = solid(200, 200, (255, 255, 255))
    grid[::8] = 0
    grid[:, ::8] = 0
    assert images.diagram(grid).startswith("D3·Diagrama técnico")


def test_saturation_and_value():
    s, v = images.saturation_value(np.array([[[200, 100, 50], [0, 0, 0], [7, 7, 7]]], np.uint8))
    assert s.tolist() == [[191, 0, 0]] and v.tolist() == [[200, 0, 7]]


def test_diagram_judges_by_the_whole_edge_mask():
    """Leaving an image early changes no verdict: flat, faint, noisy and lined ones against all steps one after another."""
    rng = np.random.default_rng(1)
    lined = [solid(h, h, (250, 250, 250)) for h in (60, 150, 200)]
    for image, step in zip(lined, (9, 11, 8), strict=True):
        image[::step] = 0
        image[:, ::step] = 0
    noise = [np.repeat(rng.integers(200, high, (50, 40, 1)), 3, axis=2).astype(np.uint8) for high in (203, 209, 230, 256)]
    noise.append(rng.integers(0, 256, (50, 40, 3)).astype(np.uint8))
    faint = [solid(40, 30, (200, 200, 200)) for _ in range(3)]
    for image, change in zip(faint, (8, 9, 20), strict=True):
        image[:, 15:] += np.uint8(change)
    for image in (solid(1, 1, (0, 0, 0)), solid(60, 60, (200, 200, 200)), *lined, *noise, *faint):
        edges = images.canny(images.luma(image))
        lines = images.straight_lines(edges)
        rejected = edges.mean() > images.EDGE_SHARE and lines >= images.LINES
        assert images.diagram(image) == (f"D3·Diagrama técnico: ratio_bordes={edges.mean():.3f}, líneas_rectas={lines}" if rejected else None)
    assert all(images.diagram(image) for image in lined[1:])


def test_image_without_contrast_is_not_searched_for_edges(monkeypatch):
    monkeypatch.setattr(images, "_filter3", None)
    image = solid(60, 60, (200, 200, 200))
    image[20:, 30:] = (206, 206, 206)
    assert images.first_reason(image) is None


def test_images_of_one_small_file_are_judged_in_many_tasks(spark):
    from lonja.queries import QUERIES

    tasks = QUERIES["image_rules"](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def fragment(text, confidence=0.9, at=500.0, saturation=0.0):
    return ([[at, at], [at + 10, at], [at + 10, at + 10], [at, at + 10]], text, confidence, saturation)


def reason(spark, *fragments, **rules):
    schema = "f array<struct<bbox: array<array<double>>, text: string, confidence: double, saturation: double>>"
    df = spark.createDataFrame([(list(fragments),)], schema)
    return df.select(images.text_reason("f", F.lit(1000.0), F.lit(1000.0), images.TextRules(**rules))).first()[0]


def test_text_rules(spark):
    assert reason(spark) is None and reason(spark, fragment("Bracket")) is None
    assert reason(spark, fragment("available"), fragment("Image"), fragment("NOT")) == "D6·Imagen placeholder: contiene 'not available'"
    assert reason(spark, fragment("FREE Shipping")) == "D4·Texto comercial: 'FREE Shipping' (palabras: free, shipping, conf=0.90)"
    assert reason(spark, fragment("thank"), fragment("you")) == "D4·Texto comercial (frase): 'thank you'"
    assert reason(spark, fragment("free", 0.3)) is None and reason(spark, fragment("AB1234", at=5.0, saturation=99.0)) is None
    assert reason(spark, fragment("logo", at=5.0, saturation=99.0)) == "D5·Logo/texto en esquina: 'logo' (conf=0.90)"
    assert reason(spark, fragment("logo", saturation=99.0)) is None and reason(spark, fragment("logo", at=5.0, saturation=20.0)) is None
    assert reason(spark, *[fragment("sale now")] * 8).count(" | ") == 4


def test_cascade_reads_survivors_only(spark):
    grey = solid(60, 60, (200, 200, 200))
    red = grey.copy()
    red[:20] = (220, 20, 20)
    rows = [(0, "a", 60, 60, red.tobytes(), None), (1, "a", 60, 60, grey.tobytes(), None), (2, "a", 60, 60, None, "estado HTTP 404"), (3, "a", 61, 60, grey.tobytes(), None)]
    df = spark.createDataFrame(rows, "idx long, col string, height int, width int, rgb binary, failure string")

    def make():
        class Fake:
            def read(self, image):
                return [{"bbox": [[1.0, 1.0]] * 4, "text": "big sale", "confidence": 0.8}]

        return Fake()

    found = {r.idx: (r.approved, r.reason) for r in images.judge_images(df, ocr.recogniser(make)).collect()}
    assert found[0][1].startswith("D1") and found[1] == (False, "D4·Texto comercial: 'big sale' (palabras: sale, conf=0.80)")
    assert found[2] == (False, "estado HTTP 404") and found[3][1].startswith("Imagen ilegible")
    assert {r.idx: r.approved for r in images.judge_images(df).collect()} == {0: False, 1: True, 2: False, 3: False}


def test_decoding():
    p = np.array([[0.1, 0.6, 0.2, 0.1], [0.1, 0.6, 0.2, 0.1], [0.9, 0.05, 0.03, 0.02], [0.1, 0.5, 0.1, 0.3], [0.0, 0.1, 0.8, 0.1]])
    text, sure = ocr.decode(p, "abc")
    assert text == "aab" and np.isclose(sure, (0.6 * 0.6 * 0.5 * 0.8) ** (2 / 2))
    masked = ocr.mask_languages(p, "abc", "bc")
    assert np.allclose(masked.sum(axis=1), 1) and masked[:, 1].max() == 0
    assert ocr.decode(np.array([[1.0, 0.0]]), "a") == ("", 0.0)
    assert np.allclose(ocr.softmax(np.array([[0.0, np.log(3)]])), [[0.25, 0.75]])


def test_boxes_and_lines():
    text, link = np.zeros((60, 120)), np.zeros((60, 120))
    text[10:20, 10:40], text[10:20, 60:100], text[40:44, 5:7] = 0.9, 0.9, 0.9
    link[14:16, 40:44] = 0.9
    found = ocr.text_boxes(text, link)
    assert len(found) == 2 and (found[0][0] <= [10, 10]).all() and found[0][2][0] >= 39
    assert ocr.regions(np.array([[1, 0, 1], [1, 1, 1], [0, 0, 0], [1, 0, 1]], bool)).tolist() == [[1, 0, 1], [1, 1, 1], [0, 0, 0], [2, 0, 3]]
    level, tilted = ocr.group_lines([np.array([[0, 0], [30, 0], [30, 10], [0, 10]], float), np.array([[33, 1], [60, 1], [60, 11], [33, 11]], float), np.array([[0, 50], [30, 90], [25, 95], [-5, 55]], float)])
    assert level == [[-1, 61, -1, 12]] and len(tilted) == 1
    corners = ocr.smallest_rectangle(np.array([[0, 0], [4, 0], [4, 2], [0, 2], [2, 1]]))
    assert sorted(map(tuple, np.round(corners, 6).tolist())) == [(0, 0), (0, 2), (4, 0), (4, 2)]


def test_crops_and_inputs():
    grey = np.arange(100, dtype=np.uint8).reshape(10, 10)
    assert ocr.crop_level(grey, [2, 5, 1, 4]).tolist() == grey[1:4, 2:5].tolist()
    assert np.abs(ocr.crop_tilted(grey, np.array([[2, 1], [6, 1], [6, 5], [2, 5]])).astype(int) - ocr.resize(grey[1:5, 2:6], 4, 4).astype(int)).max() <= 15
    assert ocr.recogniser_input(np.zeros((10, 25), np.uint8)).shape == (1, 64, 192) and ocr.recogniser_input(np.zeros((2, 200), np.uint8)) is None
    assert ocr.fit(np.zeros((10, 2000, 3), np.uint8), 900).shape == (4, 900, 3) and ocr.canvas(np.zeros((33, 40, 3), np.uint8))[0].shape == (64, 64, 3)
    assert (ocr.resize(solid(5, 7, (9, 8, 7)), 11, 3) == (9, 8, 7)).all()


def test_reader_with_plugged_models():
    def detect(x):
        maps = np.zeros((1, x.shape[2] // 2, x.shape[3] // 2, 2))
        maps[0, 10:20, 10:60, 0] = 0.9
        return maps

    def recognise(x):
        scores = np.full((1, 3, 4), -9.0)
        scores[0, 0, 1] = scores[0, 1, 2] = scores[0, 2, 0] = 9.0
        return scores

    reader = ocr.Reader(detect, recognise, "abc", "ab")
    found = reader.read(solid(64, 160, (200, 200, 200)))
    assert [r["text"] for r in found] == ["ab"] and found[0]["confidence"] > 0.99


def test_swapped_bytes(spark):
    df = spark.createDataFrame(pd.DataFrame({"data": [bytes([1, 2, 3, 4, 5, 6])]}))
    assert bytes(df.select(images.bgr_to_rgb(F.col("data"))).first()[0]) == bytes([3, 2, 1, 6, 5, 4])


@pytest.fixture
def shop(tmp_path):
    """A server of four images: plain, with a banner, damaged, and one that is not there."""

    def png(image):
        def chunk(name, data):
            return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

        rows = b"".join(b"\0" + row.tobytes() for row in image)
        head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")

    plain = solid(60, 60, (200, 200, 200))
    red = plain.copy()
    red[:20] = (220, 20, 20)
    files = {"/plain.png": png(plain), "/red.png": png(red), "/broken.png": b"\x89PNG\r\n\x1a\n...."}
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append(self.path)
            body = files.get(self.path)
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", "image/png")
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen, files
    server.shutdown()


def test_urls_to_verdicts_and_resume(spark, tmp_path, shop):
    root, seen, _ = shop
    rows = [(0, f"{root}/plain.png", f"{root}/red.png"), (1, f"{root}/broken.png", f"{root}/lost.png"), (2, None, "no url"), (3, f"{root}/red.png", None)]
    df = spark.createDataFrame(rows, "_ord long, a string, b string")
    options, store = FetchOptions(allow_private=True, attempts=1, timeout=5), str(tmp_path / "store")
    found = {(r.idx, r.col): (r.approved, r.reason) for r in images.resume(df, ["a", "b"], store, 3, options).collect()}
    assert found[0, "a"] == (True, "") and found[0, "b"][1].startswith("D1") and found[3, "a"] == found[0, "b"] and len(found) == 5
    assert found[1, "a"][1] == "Descargada, pero no es una imagen válida o supera los límites" and found[1, "b"][1] == "No se pudo descargar: estado HTTP 404"
    assert len(seen) == 5
    more = df.union(spark.createDataFrame([(4, f"{root}/plain.png", None)], df.schema))
    assert images.resume(more, ["a", "b"], store, 3, options).count() == 6 and len(seen) == 6
    direct = {(r.idx, r.col): (r.approved, r.reason) for r in images.judge_urls(cells.cells(df, ["a", "b"]), options).collect()}
    assert direct == found


def test_resume_reads_text_of_survivors(spark, tmp_path, shop):
    root, seen, _ = shop
    df = spark.createDataFrame([(0, f"{root}/plain.png"), (1, f"{root}/red.png")], "_ord long, a string")

    def make():
        class Fake:
            def read(self, image):
                return [{"bbox": [[1.0, 1.0]] * 4, "text": "big sale", "confidence": 0.8}]

        return Fake()

    got = images.resume(df, ["a"], str(tmp_path / "s"), 1, FetchOptions(allow_private=True, attempts=1), ocr.recogniser(make))
    assert {r.idx: r.reason[:2] for r in got.collect()} == {0: "D4", 1: "D1"} and len(seen) == 2
    assert not (tmp_path / "s_examined").exists()


def test_image_tool(spark, tmp_path, shop):
    root, seen, _ = shop
    (tmp_path / "in.csv").write_text(f"Sku,Foto 1,Foto 2\n1,{root}/red.png,{root}/plain.png\n2,{root}/red.png,\n")
    routes = tools.images(spark, [str(tmp_path / "in.csv")], str(tmp_path / "store"), batches=2, allow_private=True)
    # A cell without an image counts as approved, so the second row is among them, its image taken out.
    assert sorted((r["Sku"], r["Foto 1"]) for r in routes["Aprobadas"].collect()) == [("1", f"{root}/plain.png"), ("2", "")]
    assert sorted((r["Sku"], r["Motivo_Rechazo"][:13]) for r in routes["Rechazadas"].collect()) == [("1", "[Foto 1] D1·B"), ("2", "[Foto 1] D1·B")]
    assert len(seen) == 3


def test_workbook_with_images(spark, tmp_path, shop):
    root, _, _ = shop
    rows = [(0, "x", f"{root}/red.png, {root}/plain.png", "n"), (1, "y", f"{root}/broken.png", None), (2, None, None, "m"), (3, "z", None, "<&>")]
    df = spark.createDataFrame(rows, "_ord long, Sku string, Foto string, Nota string")
    path = embed.write_with_images(df, ["Foto"], str(tmp_path / "album.xlsx"), FetchOptions(allow_private=True, attempts=1))
    back = [tuple(r) for r in read_xlsx(spark, path).orderBy("_ord").select("Sku", "Foto", "Foto_imagen_1", "Foto_imagen_2", "Nota").collect()]
    assert back == [("x", rows[0][2], None, None, "n"), ("y", rows[1][2], "Error", None, None), (None, None, None, None, "m"), ("z", None, None, None, "<&>")]
    with zipfile.ZipFile(path) as book:
        for name in book.namelist():
            if not name.endswith(".png"):
                ElementTree.fromstring(book.read(name))
        pictures = [pixels.decode(book.read(f"xl/media/img_{n}.png")) for n in (1, 2)]
        drawing = book.read("xl/drawings/drawing1.xml").decode()
        sheet = book.read("xl/worksheets/sheet1.xml").decode()
    assert [p.shape for p in pictures] == [(168, 118, 3)] * 2 and pictures[0][0, 0].tolist() == [220, 20, 20] and (pictures[1] == 200).all()
    assert drawing.count("<xdr:col>2</xdr:col>") == drawing.count("<xdr:col>3</xdr:col>") == 1 and drawing.count("<xdr:row>1</xdr:row>") == 2
    assert 'defaultRowHeight="126.0"' in sheet and sheet.count("<col ") == 2


def test_columns_of_a_full_sheet():
    assert embed.granted({"a": 3, "c": 5}, ["a", "b", "c"]) == {"a": 3, "c": 5}
    assert embed.granted({"a": 3, "c": 5}, ["a", "b", "c"], 8) == {"a": 3, "c": 2}
    assert embed.pixels_to_points(168) == 126 and round(embed.pixels_to_width(118), 6) == 16.857143


def test_decoded_column(spark, shop):
    files = shop[2]
    rows = [(0, files["/plain.png"]), (1, files["/broken.png"]), (2, None)]
    found = spark.createDataFrame(rows, "idx int, content binary").select("idx", images.decoded(F.col("content"), 30).alias("d")).orderBy("idx").select("d.*").collect()
    assert (found[0].height, found[0].width, bytes(found[0].rgb)) == (30, 30, b"\xc8" * 2700)
    assert [tuple(r) for r in found[1:]] == [(None, None, None)] * 2
