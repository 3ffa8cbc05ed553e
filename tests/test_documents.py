"""Structured documents, sections nested three deep, broken ones and empty ones."""

import pytest

from tracewell.sources import documents as D

MINI = """<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body>
<div><head n="1">Introduction</head><p>We build on <ref type="bibr" target="#b0">[1]</ref> and
   <ref type="bibr" target="#b1">[2, 3]</ref>, see <ref type="figure" target="#f0">Fig. 1</ref>. Again <hi>as in</hi> <ref type="bibr">[1]</ref>.</p></div>
<div><head>Method</head><p>Plain.</p>
  <div><head>Loss</head><formula xml:id="e0">L = a + b <label>(1)</label></formula>
    <div><head>Ablation of parts</head><figure type="table" xml:id="t0"><head>Table 1</head><label>1</label><figDesc>Without parts</figDesc><table><row><cell>Name</cell><cell>Rate</cell></row><row><cell>A<hi>b</hi></cell><cell/></row></table></figure><p>Deep <formula>x</formula> text.</p></div>
    <p>After.</p></div>
  <div><figure xml:id="f0"><head>Fig. 1</head><graphic/></figure></div></div>
<div><head>Results</head><div><p/><figure type="table"><head>Scores</head><table><row><cell>only</cell></row></table></figure></div></div>
</body></text></TEI>"""


@pytest.fixture
def events(spark, tmp_path):
    (tmp_path / "one.tei.xml").write_text(MINI)
    (tmp_path / "broken.xml").write_text("<TEI><text><div><head>A</head><p>kept</p><p>lost")
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "bare.xml").write_text("<TEI/>")
    (tmp_path / "notes.txt").write_text("no document")
    return D.read_events(spark, str(tmp_path))


def test_sections_of_any_depth(events):
    got = [(r["level"], list(r["path"]), r["heading"], list(r["parents"])) for r in D.sections(events).where("paper = 'one'").orderBy("at").collect()]
    assert got == [
        (1, [0], "Introduction", []), (1, [1], "Method", []), (2, [1, 0], "Loss", ["Method"]), (3, [1, 0, 0], "Ablation of parts", ["Method", "Loss"]), (2, [1, 1], "", ["Method"]), (1, [2], "Results", []), (2, [2, 0], "", ["Results"]),
    ]


def test_tables_know_the_headings_around_them(events):
    got = D.located_tables(events, ("results",), ("ablation",)).orderBy("at").collect()
    assert [(r["section"], r["caption"], r["rows"], r["is_results"], r["is_ablation"]) for r in got] == [
        ("Ablation of parts", "Without parts", [["Name", "Rate"], ["Ab", ""]], False, True), ("Results", "Scores", [["only"]], True, False),
    ]


def test_formulas_and_figures(events):
    assert [tuple(r)[2:4] for r in D.formulas(events).collect()] == [("(1)", "L = a + b")]
    assert [(r["label"], r["caption"], r["headings"]) for r in D.figures(events).collect()] == [("f0", "Fig. 1", ["Method", ""])]
    assert [r["text"] for r in events.where("kind = 'paragraph' AND paper = 'one'").orderBy("at").collect()][2:] == ["Deep x text.", "After."]


def test_every_citation_has_its_place(events):
    got = D.cited_places(events).orderBy("at").collect()
    assert [(r["entry"], r["marker"]) for r in got] == [("b0", "[1]"), ("b1", "[2, 3]"), (None, "[1]")]
    for r in got:
        assert r["paragraph"][r["offset"] : r["offset"] + len(r["marker"])] == r["marker"]
    assert got[0]["paragraph"] == "We build on [1] and [2, 3], see Fig. 1. Again as in [1]."


def test_broken_and_empty_documents(events):
    got = {(r["paper"], r["kind"], r["text"]) for r in events.where("paper <> 'one'").select("paper", "kind", "text").collect()}
    assert {("broken", "section", "A"), ("broken", "paragraph", "kept")} <= got
    assert {p for p, kind, _ in got if kind == "error"} == {"broken"} and not any(p in ("empty", "bare", "notes") for p, *_ in got)
