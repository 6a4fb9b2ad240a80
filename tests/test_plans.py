"""Plans are the ones wanted: narrow scans, no nested loops over data, no Python where expressions do."""

import re

import pytest

from lonja.queries import QUERIES

SF = "/root/testdata/sf0.001"
PYTHON = {"image_rules"}
THETA = {"vlookup_partial_longest", "vlookup_partial_first", "vlookup_partial_all", "find_words_first", "find_words_all"}
ONE_ROW = {"change_report", "blank_tail"}


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "url_detect"])
def test_no_python_and_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert name in PYTHON or not re.search("Python|Arrow|Pandas", text)
    assert "CartesianProduct" not in text
    # Small phrase lookups are one row that is attached to each text, as other one-row aggregates are.
    assert name in THETA | ONE_ROW or "NestedLoop" not in text


def test_scans_read_only_the_columns_used(spark):
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "char_counts")) == ["doc_id:bigint,text:string"]
    assert re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "sku_build")) == ["p_partkey:bigint,p_name:string,p_brand:string,p_type:string,p_size:int"]


def test_filters_reach_the_scan(spark):
    from lonja.queries import table

    text = table(spark, SF, "events").where("value < 5")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(value,5.0)" in text


@pytest.mark.parametrize(("name", "call", "most", "scans"), [("features", "regexp_extract_all", 4, 1), ("title_cheapest", "regexp_replace", 20, 1), ("find_words_all", "regexp_replace", 3, 1)])
def test_expressions_are_computed_once(spark, name, call, most, scans):
    text = plan(spark, name)
    assert text.count(call) <= most and len(re.findall(r"FileScan parquet", text)) == scans
