"""File sources, guarded writes, the operator registry and number grounding."""

import json

from pyspark.sql import functions as F

from tracewell.operators import registry, resolution
from tracewell.sources import files


def test_methods_table_keeps_quoted_lines_and_blanks(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Name,Kind\n"a, b","x\ny"\nc,\n')
    assert [tuple(r) for r in files.read_methods(spark, f"{tmp_path}/m.csv").collect()] == [("a, b", "x\ny"), ("c", "")]


def test_graph_drops_dangling_edges(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "type": "t"}, {"source": "a", "target": "z", "type": "t"}]}))
    nodes, edges = files.read_graph(spark, f"{tmp_path}/g.json")
    assert nodes.count() == 2 and [(r["source"], r["target"]) for r in edges.collect()] == [("a", "b")]


def test_xml_tables(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<tei><figure type="table"><head>T</head><table><row><cell>a</cell><cell>1</cell></row><row><cell>b</cell><cell>2</cell></row></table></figure><figure><head>F</head></figure></tei>')
    assert [tuple(r) for r in files.read_tables(spark, f"{tmp_path}/d.xml").collect()] == [("T", [["a", "1"], ["b", "2"]])]


def test_guarded_write_keeps_what_would_be_lost(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    two, one = spark.createDataFrame([("p", 1), ("q", 2)], "paper string, v int"), spark.createDataFrame([("p", 1)], "paper string, v int")
    assert files.guarded_write(two, path)
    assert not files.guarded_write(two.limit(0), path) and spark.read.parquet(path).count() == 2
    assert not files.guarded_write(one, path, "paper") and files.guarded_write(one, path, "paper", force=True)
    assert spark.read.parquet(path).count() == 1


def test_registry_calls_and_refuses(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a"],)], "words array<string>")
    found = registry.execute("value_distribution", df, column="words")
    assert found["success"] and {(r["item"], r["n"]) for r in found["result"].collect()} == {("a", 2), ("b", 1)}
    assert not registry.execute("nothing", df)["success"] and not registry.execute("value_distribution", df)["success"]
    assert [r["success"] for r in registry.execute_all([("value_distribution", {"column": "words"})] * 6, df)] == [True] * 5 + [False]
    assert any(s["name"] == "nearest_neighbors" and s["parameters"]["required"] == ["queries", "k"] for s in registry.schemas())


def test_numbers_and_acronyms(spark):
    rows = spark.createDataFrame([("we got 12.50 and 3 in 2001, 77", "12.5")], "a string, e string")
    assert rows.select(resolution.ungrounded_numbers(F.col("a"), F.col("e"))).first()[0] == ["77"]
    docs = spark.createDataFrame([(1, "a Deep Neural Net (DNN) and Some Thing (XY)"), (2, "our dense new net (DNN)")], "doc_id long, text string")
    assert [tuple(r) for r in resolution.acronyms(docs).collect()] == [("DNN", "Deep Neural Net", 2)]
