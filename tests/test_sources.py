import http.server
import os
import threading
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lonja.sources import csv, fetch, verdicts, xlsx
from lonja.streaming import incremental

CODES = ["007", "1e5", "1.50", "+34", "0000", "=A1", " edge ", "<&>\"'", "ñ日本😀", "tab\tline\nend", "\x01\x0bctl"]


def test_numbers_and_references():
    assert [xlsx.number_text(v) for v in (5.0, 1.5, 1e14, 1e15, 1e-7, -0.25)] == ["5", "1.5", "100000000000000", "1000000000000000", "0.0000001", "-0.25"]
    assert [xlsx.column_index(r) for r in ("A1", "BC12", "12", "ZZZZ1")] == [0, 54, None, None]
    assert all(xlsx.column_index(xlsx.column_letters(i) + "1") == i for i in (0, 25, 26, 701, 702, 16383))


def test_round_trip_keeps_text(spark, tmp_path):
    df = spark.createDataFrame([(i, c, None if i % 2 else "x") for i, c in enumerate(CODES)], "_ord long, Sku string, Nombre string")
    path = xlsx.write_xlsx({"Hoja 1/x": df}, str(tmp_path / "b.xlsx"))
    found = xlsx.read_xlsx(spark, path).orderBy("_ord").collect()
    clean = [c.replace("\x01", "").replace("\x0b", "") for c in CODES]
    assert [r.Sku for r in found] == clean and {r._sheet for r in found} == {"Hoja 1_x"}
    assert [r.Nombre for r in found] == [None if i % 2 else "x" for i in range(len(CODES))]
    assert xlsx.write_xlsx(df, path) == str(tmp_path / "b(1).xlsx")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text(max_size=12), st.text(max_size=12)), min_size=1, max_size=8))
def test_writer_and_parser_agree_on_any_text(tmp_path, values):
    writer = xlsx.XlsxWriter(str(tmp_path / "p.xlsx"), overwrite=True)
    rows = [("end", "end")]
    kept = [tuple(v if v.isprintable() else "p" for v in r) for r in values] + rows
    writer.write(["a", "b"], kept)
    book = xlsx.Workbook(open(writer.close(), "rb").read())
    found = [tuple((c or "") for c in [*r, None, None][:2]) for r in book.rows(book.sheets[0][1])]
    assert found == [("a", "b"), *kept]


def test_sheets_are_split_aligned_and_trimmed(spark, tmp_path):
    writer = xlsx.XlsxWriter(str(tmp_path / "s.xlsx"), rows_per_sheet=10)
    writer.write(["Sku"], [(str(i),) for i in range(25)])
    with pytest.warns(UserWarning):
        writer.write(["Otro", "Sku"], [("x", "25"), (None, None)])
    writer.write(["Sku"], [("",), ("27",), (None,)])
    path = writer.close()
    assert [r["sheet"] for r in xlsx.catalogue(spark, path).orderBy("sheet_no").collect()] == ["Hoja1", "Hoja1_2", "Hoja1_3"]
    found = [r.Sku for r in xlsx.read_xlsx(spark, path).orderBy("_ord").collect()]
    assert found[:26] == [str(i) for i in range(26)] and found[-1] == "27" and len(found) == 29 and xlsx.total_rows(spark, path) == 29


def test_broken_books_warn_and_failures_leave_no_file(spark, tmp_path):
    (tmp_path / "bad.xlsx").write_bytes(b"PK truncated")
    writer = xlsx.XlsxWriter(str(tmp_path / "good.XLSX"))
    writer.write(["a", "", "a"], [("1", "2", "3")], "Uno")
    writer.write(["b"], [("9",)], "Dos")
    writer.close()
    with pytest.warns(UserWarning):
        df = xlsx.read_xlsx(spark, str(tmp_path), exclude=[" DOS "])
    assert df.columns == ["a", "Columna_2", "a_1", "_file", "_sheet", "_ord"] and df.count() == 1
    bad = spark.range(3).select(F.raise_error("stop").cast("string").alias("x"))
    with pytest.raises(Exception):
        xlsx.write_xlsx(bad, str(tmp_path / "never.xlsx"))
    assert sorted(os.listdir(tmp_path)) == ["bad.xlsx", "good.XLSX"]
    with pytest.raises(ValueError):
        xlsx.Workbook((tmp_path / "good.XLSX").read_bytes(), max_unpacked=10)


def test_shared_strings_types_and_gaps(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="H" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>head</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si></sst>")
        cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>2.0</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{cells}</sheetData></worksheet>")
    found = xlsx.read_xlsx(spark, str(tmp_path / "s.xlsx")).orderBy("_ord").collect()
    assert [tuple(r)[:3] for r in found] == [(None, None, None), ("rich", "TRUE", "2")] and found[0].asDict().keys() >= {"head", "Columna_2", "head_1"}


def test_word_list(spark, tmp_path):
    writer = xlsx.XlsxWriter(str(tmp_path / "w.xlsx"))
    writer.write(["palabra"], [(" uno ",), ("",), ("dos",)])
    path = writer.close()
    assert [r.word for r in xlsx.read_words(spark, path).orderBy("_ord").collect()] == ["uno", "dos"]
    assert [r.word for r in xlsx.read_words(spark, path, header_is_word=True).orderBy("_ord").collect()] == ["palabra", "uno", "dos"]


def test_csv_round_trip_with_guard(spark, tmp_path):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(CODES[:10])], "_ord long, `=Sku` string")
    csv.write_csv(df.coalesce(1), str(tmp_path / "c"))
    files = sorted(str(p) for p in (tmp_path / "c").glob("*.csv"))
    found = csv.read_csv(spark, files)
    assert found.columns[0] == "'=Sku"
    assert [r[0] for r in found.orderBy("_ord").collect()] == ["'" + c if c[0] in "=+-@" else c for c in CODES[:10]]


def test_csv_unequal_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('A,B\n1,"x\ny"\n007\n1,2,3\n')
    (tmp_path / "b.csv").write_text("A,A\n5,6\n")
    found = csv.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert found.columns[:3] == ["A", "B", "_file"] and "A_1" in found.columns
    assert [(r.A, r.B, r.A_1) for r in found.orderBy("_ord").collect()] == [("1", "x\ny", None), ("007", None, None), ("1", "2", None), ("5", None, "6")]


def test_exact_parts(spark, tmp_path):
    csv.write_parts(spark.range(7).selectExpr("id as _ord", "cast(id as string) as A").repartition(4), str(tmp_path / "p"), 3)
    found = spark.read.option("header", True).csv(str(tmp_path / "p")).groupBy("part").count().orderBy("part").collect()
    assert [(r.part, r["count"]) for r in found] == [(1, 3), (2, 3), (3, 1)]


def test_verdict_store(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = "idx long, col string, approved boolean, reason string"
    verdicts.append_verdicts(spark.createDataFrame([(1, "a", True, ""), (2, "a", True, "")], rows), path, 1)
    verdicts.append_verdicts(spark.createDataFrame([(1, "a", False, "late")], rows), path, 2)
    (tmp_path / "v" / "part-x.json").write_text("{not json\n")
    assert {(r.idx, r.approved, r.reason) for r in verdicts.load_verdicts(spark, path).collect()} == {(1, False, "late"), (2, True, "")}


@pytest.mark.parametrize("address", ["127.0.0.1", "10.1.2.3", "192.168.0.1", "169.254.1.1", "224.0.0.1", "0.0.0.0", "255.255.255.255", "100.64.0.9", "192.0.2.1", "::1", "fc00::1", "fe80::1", "::ffff:10.0.0.1"])
def test_private_addresses(address):
    assert fetch.is_private(address) and not fetch.is_private("93.184.216.34")


def test_fetch(spark):
    hits = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append(self.path)
            code = 503 if self.path == "/flaky" and hits.count("/flaky") < 2 else 302 if self.path == "/moved" else 404 if self.path == "/gone" else 200
            self.send_response(code)
            self.send_header("Content-Type", "text/html" if self.path == "/page" else "image/png")
            if code == 302:
                self.send_header("Location", "/ok")
            self.end_headers()
            self.wfile.write(b"x" * 100 if code == 200 else b"")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    options = fetch.FetchOptions(allow_private=True, pause=0.01, timeout=5)
    assert fetch.fetch(root + "/ok", options)[0] == b"x" * 100 and fetch.fetch(root + "/flaky", options)[0] and fetch.fetch(root + "/moved", options)[0]
    assert fetch.fetch(root + "/gone", options) == (None, "estado HTTP 404") and fetch.fetch(root + "/page", options)[1] == "tipo de contenido text/html"
    assert fetch.fetch(root + "/ok", fetch.FetchOptions(allow_private=True, max_bytes=10))[1] == "demasiado grande"
    assert fetch.fetch(root + "/ok")[1] == "destino no permitido" and fetch.fetch("file:///etc/passwd")[1] == "URL no válida"
    tasks = spark.createDataFrame([(i, "a", f"{root}/{'ok' if i else 'gone'}") for i in range(3)], "idx long, col string, url string")
    found = {r.idx: (r.content is not None, r.failure) for r in fetch.fetch_images(tasks, options).collect()}
    assert found == {0: (False, "estado HTTP 404"), 1: (True, None), 2: (True, None)}
    server.shutdown()


def test_incremental_run_resumes(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for n in range(2):
        spark.createDataFrame([(n, f"k{n}")], "i long, k string").write.mode("append").parquet(source)
        incremental.run_available(spark, source, "i long, k string", lambda d: d.withColumn("j", F.col("i") + 1), target, mark)
        assert spark.read.parquet(target).count() == n + 1
    seen = []
    stream = spark.readStream.schema("i long, k string").parquet(source)
    incremental.each_batch(incremental.first_seen(stream, "k"), lambda df, n: seen.extend(r.k for r in df.collect()), str(tmp_path / "m2"))
    assert sorted(seen) == ["k0", "k1"]
