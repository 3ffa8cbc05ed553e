"""Focused subgraphs against the sequential walk, and versioned tables through changes, crashes and races."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import focus as X
from tracewell.sources.versions import Conflict, Versions


def walk(nodes, edges, papers, f):
    """The same subgraph, paper after paper."""
    kind, seeds = dict(nodes), [p for p in papers if p in dict(nodes)]
    near = {}
    for s, d, t in edges:
        near.setdefault(s, []).append((d, t, True))
        near.setdefault(d, []).append((s, t, False))
    known = set(seeds)
    for p in seeds:
        known |= {n for n, _, _ in near.get(p, []) if kind.get(n) in f.structural}
    for tech in [n for n in known if kind[n] == "technique"]:
        for paper, _, out in near.get(tech, []):
            if not out and kind.get(paper) == "paper":
                known.add(paper)
                known |= {m for m, _, o in near.get(paper, []) if not o and kind.get(m) == "method"}
    for p in seeds:
        known |= {n for n, t, _ in near.get(p, []) if t == "cites"}
    for p in seeds:
        n = 0
        for d, t, out in near.get(p, []):
            if out and t in f.claims and n < f.most:
                known.add(d)
                n += 1
        for d, t, out in near.get(p, []):
            if out and t in f.fallback and d not in known and n < f.most:
                known.add(d)
                n += 1
    known &= set(kind)
    links = {}
    for s, d, t in edges:
        if s in known and d in known:
            links.setdefault((s, d), t)
    touch = {n: {b for a, b in links if a == n} | {a for a, b in links if b == n} for n in known}
    return sorted((n, "claim" if kind[n] in X.CLAIMS else kind[n], kind[n], len(touch[n])) for n in known), sorted((s, d, t) for (s, d), t in links.items())


@pytest.mark.parametrize("intent", ["comparison", "limitation", "hardware", "general"])
def test_focused_subgraph(spark, intent):
    rng = random.Random(intent)
    kinds = {"paper": 14, "method": 10, "technique": 6, "hardware": 4, "contribution": 20, "comparison": 12, "limitation": 12, "problem": 8, "author": 5}
    nodes = [(f"{k}{i}", k) for k, n in kinds.items() for i in range(n)]
    relations = {"contribution": "contributes", "comparison": "compares", "limitation": "has_limitation", "problem": "addresses_problem", "technique": "uses", "hardware": "uses_hardware", "author": "authored_by", "paper": "cites"}
    edges = []
    for _ in range(420):
        s, d = f"paper{rng.randrange(14)}", rng.choice(nodes)[0]
        edges.append((f"method{rng.randrange(10)}", s, "presented_in") if rng.random() < 0.1 else (s, d, relations.get(d.rstrip("0123456789"), "about")))
    edges += [("paper1", "gone", "cites"), ("paper1", "paper1", "cites")]
    papers = ["paper1", "paper5", "missing", "paper2", "paper9", "paper11"]
    df = spark.createDataFrame([(*e, i) for i, e in enumerate(edges)], "src string, dst string, type string, seq int")
    found, links = X.focused(spark.createDataFrame(nodes, "id string, type string"), df, spark.createDataFrame([(p, i) for i, p in enumerate(papers)], "id string, place int"), intent)
    want_nodes, want_links = walk(nodes, edges, papers, X.FOCUS.get(intent, X.GENERAL))
    assert sorted(tuple(r) for r in links.collect()) == want_links
    got = sorted(tuple(r) for r in found.collect())
    assert [g[:3] for g in got] == [w[:3] for w in want_nodes]
    assert all(g[3] >= len([1]) - 1 for g in got) and {g[0]: g[3] for g in got if g[0] != "paper1"} == {w[0]: w[3] for w in want_nodes if w[0] != "paper1"}


def chunks(spark, rows):
    return spark.createDataFrame(rows, "paper string, chunk int, text string")


def table(spark, path):
    return Versions(spark, str(path), "paper", "chunk", buckets=4)


def test_versions_of_a_table(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read() is None and t.version() == 0 and t.apply() == 0
    assert t.apply(chunks(spark, [(f"p{i}", c, f"v1 {i} {c}") for i in range(20) for c in range(3)] + [(None, 0, "no paper")])) == 1
    pinned = t.read()
    files = t.manifest()["files"]
    assert t.apply(chunks(spark, [("p3", 1, "v2"), ("p3", 7, "new"), ("p3", 7, "newer")])) == 2
    now = {(r["paper"], r["chunk"]): r["text"] for r in t.read().collect()}
    assert len(now) == 62 and now["p3", 1] == "v2" and now["p3", 7] == "newer" and now["p3", 0] == "v1 3 0"
    changed = {b for b, p in t.manifest()["files"].items() if files.get(b) != p}
    assert len(changed) == 1  # the other buckets' files are the same
    assert t.apply(chunks(spark, [("p3", 0, "only")]), replace=True) == 3
    assert {(r["chunk"], r["text"]) for r in t.read().where("paper = 'p3'").collect()} == {(0, "only")}
    assert t.apply(deletes=spark.createDataFrame([("p4",), ("nowhere",)], "paper string")) == 4 and t.read().where("paper = 'p4'").count() == 0
    assert t.retain(spark.createDataFrame([(f"p{i}",) for i in range(10)], "paper string")) == 5
    assert {r[0] for r in t.read().select("paper").distinct().collect()} == {f"p{i}" for i in range(10) if i != 4} | {None}
    assert pinned.count() == 61 and t.read(1).count() == 61  # readers keep the version they began with
    assert t.vacuum(keep=2) and t.read().count() == t.read(5).count() and t.read(4).count() == 3 * 18 + 1 + 1


def test_a_writer_that_dies_or_is_late_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.apply(chunks(spark, [("a", 0, "x"), ("b", 0, "y")]))

    def dies(*_):
        raise OSError("killed")

    monkeypatch.setattr(Versions, "_commit", dies)
    with pytest.raises(OSError):
        t.apply(chunks(spark, [("a", 0, "lost")]))
    monkeypatch.undo()
    assert sorted(map(tuple, t.read().collect())) == [("a", 0, "x"), ("b", 0, "y")]
    late = table(spark, tmp_path / "t")
    slow = Versions._write

    def overtaken(self, rows, touched, before, manifest):
        monkeypatch.setattr(Versions, "_write", slow)
        t.apply(chunks(spark, [("b", 0, "first")]))
        return slow(self, rows, touched, before, manifest)

    monkeypatch.setattr(Versions, "_write", overtaken)
    with pytest.raises(Conflict):
        late.apply(chunks(spark, [("a", 0, "second")]))
    assert sorted(map(tuple, t.read().collect())) == [("a", 0, "x"), ("b", 0, "first")]
    assert len(t.vacuum()) == 2  # what the dead and the late writer left
    assert sorted(map(tuple, t.read().collect())) == [("a", 0, "x"), ("b", 0, "first")]
    assert t.apply(deletes=t.read().select("paper")) == 3 and t.read().count() == 0 and t.read().columns == ["paper", "chunk", "text"]
