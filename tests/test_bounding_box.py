"""E17 over lines: every vertex counts once, and a text is parsed once."""

from arcweave.checks.catalog import all_queries
from arcweave.functions import parse_linestring
from arcweave.operators.aggregates import bounding_box

from conftest import SF_SMALL


def test_texts_are_parsed_once(spark):
    tree = all_queries()["e17_bounding_box_edges"].build(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("regexp_extract_all" in x for x in tree.splitlines()) == 1


def test_lines_with_gaps(spark):
    line = "array<struct<lon:double,lat:double>>"
    lines = spark.createDataFrame([([(1.0, 5.0), (3.0, None)],), (None,), ([],), ([None, (-2.0, 7.0)],)], f"line {line}")
    assert tuple(bounding_box(None, lines, pad=0.0).first()) == (-2.0, 5.0, 3.0, 7.0, 4)
    none = bounding_box(None, lines.filter("line is null"), pad=0.0).first()
    assert tuple(none) == (None, None, None, None, 0)
    texts = spark.createDataFrame([("LINESTRING (0 1, 4 5)",), ("POINT (9 9)",), (None,)], "g string")
    assert tuple(bounding_box(None, texts.select(parse_linestring("g").alias("line")), pad=0.0).first()) == (0, 1, 4, 5, 2)
