import pytest

from lonja import tools
from lonja.sources.xlsx import XlsxWriter, read_xlsx


@pytest.fixture
def book(tmp_path):
    writer = XlsxWriter(str(tmp_path / "in.xlsx"))
    writer.write(["Sku", "Nombre"], [("007", "Rueda grande"), ("7", "rueda"), ("0-07", "caja"), ("x", "")])
    return writer.close()


def test_modes_from_workbook_to_workbook(spark, tmp_path, book):
    found = tools.duplicates(spark, [book], "Sku")
    tools.write(found, str(tmp_path / "out.xlsx"))
    back = read_xlsx(spark, str(tmp_path / "out.xlsx"))
    assert sorted((r._sheet, r.Sku) for r in back.collect()) == [("Duplicados", "0-07"), ("Duplicados", "007"), ("Limpio", "007"), ("Limpio", "7"), ("Limpio", "x")]
    assert [r.Sku for r in tools.sort(spark, [book], "Sku")["Hoja1"].collect()] == ["007", "7", "0-07", "x"]
    assert tools.lengths(spark, [book], "Nombre", limit=5)["Mas_de_5"].count() == 1
    assert [r.Palabra_encontrada for r in tools.find(spark, [book], "Nombre", ["RUEDA", "caja"])["Hoja1"].orderBy("_ord").collect()] == ["RUEDA", "RUEDA", "caja", ""]
    assert tools.vlookup(spark, [book], "Sku", book, "Sku", ["Nombre"])["Hoja1"].columns[0] == "Nombre_tabla"
    assert tools.compare(spark, [book], "Sku", book, "Sku")["Limpio"].count() == 0
    assert tools.delete_words(spark, [book], ["Nombre"], ["rueda"])["Borradas"].count() == 2
    assert tools.combine(spark, [book, book], sort="Nombre")["Hoja1"].count() == 8


def test_compatibility_book(spark, tmp_path):
    writer = XlsxWriter(str(tmp_path / "c.xlsx"))
    writer.write(["web-scraper-start-url", "Precio", "Titulo", "Tienda", "Imagen 1"], [("u1", "$9.50", "Front kit", "S", "http://i/a.jpg"), ("u2", "$9.50", "x", "S", "http://i/a.jpg")], "Hoja1")
    writer.write(["web-scraper-start-url", "Traducido", "Marca", "Litros"], [("u1", "Soporte", "Acme", "2.0 l"), ("u1", "Soporte", "Acme", "2.0 l")], "Hoja2")
    writer.write(["web-scraper-start-url"], [("u2",)], "Resumen")
    (tmp_path / "b.csv").write_text("# low,high,price\n1,50,100\n")
    routes = tools.compatibility(spark, [writer.close()], str(tmp_path / "b.csv"))
    assert [(r.Combinada, r.Sku) for r in routes["Procesadas"].collect()] == [("Kit Soporte Frontal Acme 2", "u-9-s--1")]
    assert routes["No_Procesadas"].count() == 1


def test_command_line(spark, tmp_path, book):
    tools.main(["lengths", "--in", book, "--out", str(tmp_path / "o.xlsx"), "--column", "Nombre", "--limit", "5"])
    assert {r._sheet for r in read_xlsx(spark, str(tmp_path / "o.xlsx")).collect()} == {"Hasta_5", "Mas_de_5"}
