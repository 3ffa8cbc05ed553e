"""Betweenness, mentions, header clusters, keyphrases and outliers against plain sequential versions."""

import itertools
import math
import random
import re
from collections import deque

import numpy as np
import pytest

from tracewell.operators import betweenness, headers, keyphrases, mentions, retrieval


def brandes(edges, directed):
    out = {}
    for a, b in edges:
        out.setdefault(a, set())
        out.setdefault(b, set())
        if a != b:
            out[a].add(b)
            if not directed:
                out[b].add(a)
    score = dict.fromkeys(out, 0.0)
    for s in out:
        dist, paths, order, before = {s: 0}, {s: 1}, [], {}
        queue = deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before.setdefault(w, []).append(v)
        depends = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before.get(w, []):
                depends[v] += paths[v] / paths[w] * (1 + depends[w])
            if w != s:
                score[w] += depends[w]
    n = len(out)
    return {v: x / max(1, (n - 1) * (n - 2)) for v, x in score.items()}


@pytest.mark.parametrize("directed, batch", [(True, 1024), (False, 60)])
def test_betweenness_of_two_hundred_nodes(spark, directed, batch):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(200)}", f"n{int(200 * rng.random() ** 2)}") for _ in range(420)] + [("hub", f"n{i}") for i in range(0, 200, 3)] + [("a", "a"), ("hub", "n0")]
    got = {r["id"]: r["betweenness"] for r in betweenness.betweenness(spark.createDataFrame([*edges, (None, "n1")], "src string, dst string"), directed, batch).collect()}
    want = brandes(edges, directed)
    assert got.keys() == want.keys() and all(got[v] == pytest.approx(want[v], abs=1e-12) for v in want)


def test_betweenness_of_small_graphs(spark):
    assert betweenness.betweenness(spark.createDataFrame([], "src string, dst string")).count() == 0
    two = betweenness.betweenness(spark.createDataFrame([("a", "b")], "src string, dst string")).collect()
    assert sorted(map(tuple, two)) == [("a", 0.0), ("b", 0.0)]


TEXTS = [
    ("p1", "The Fox-Net planner beats HoldNet; fox net 2.0 and FOX-NET 2.0 are its\nsuccessors, while holdnets and _holdnet_ are not meant. " * 2),
    ("p2", "HoldNet (and ẞtrange İnputs) HOLDNET-1B. C++ or c++? " + "x" * 100 + " fox-net 2.0"), ("p3", "short HoldNet"), ("p4", None), ("p5", "nothing of the kind is named here " * 5),
]
ALIASES = [("dex", "Fox-Net"), ("dex", "fox net 2.0"), ("dex", "Fox-Net 2.0"), ("p2", "HoldNet"), ("grasp", "holdnet"), ("grasp", "HoldNet-1B"), ("cpp", "C++"), ("none", ""), ("none", None), ("dex", "net")]


def named_by_regex(texts, aliases):
    out = []
    for source, text in texts:
        for target in {t for t, a in aliases if a}:
            pattern = re.compile(r"\b(" + "|".join(re.escape(a) for a in sorted((a for t, a in aliases if t == target and a), key=len, reverse=True)) + r")\b", re.IGNORECASE)
            hits = list(pattern.finditer(text or ""))
            if text and len(text) >= 100 and hits and source != target:
                out.append((source, target, len(hits), [text[max(0, m.start() - 100) : m.end() + 100].replace("\n", " ").strip() for m in hits[:3]], hits[0][0]))
    return sorted(out)


@pytest.mark.parametrize("characters", [1_000_000, 12])
def test_mentions_agree_with_a_pattern_per_target(spark, characters):
    found = mentions.mentions(spark.createDataFrame(TEXTS, "source string, text string"), spark.createDataFrame(ALIASES, "target string, alias string"), characters=characters)
    assert sorted((r["source"], r["target"], r["mentions"], r["contexts"], r["matched"]) for r in found.collect()) == named_by_regex(TEXTS, ALIASES)


def test_mentions_of_random_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab-") for _ in range(rng.randrange(1, 4)))
    texts = [(f"s{i}", " ".join(word() for _ in range(80))) for i in range(40)]
    aliases = [(f"t{rng.randrange(9)}", " ".join(word() for _ in range(rng.randrange(1, 4)))) for _ in range(60)]
    got = mentions.mentions(spark.createDataFrame(texts, "source string, text string"), spark.createDataFrame(aliases, "target string, alias string"), characters=40)
    assert sorted((r["source"], r["target"], r["mentions"], r["contexts"], r["matched"]) for r in got.collect()) == named_by_regex(texts, aliases)
    empty = mentions.mentions(spark.createDataFrame(texts, "source string, text string"), spark.createDataFrame([], "target string, alias string"))
    assert empty.count() == 0


def test_name_forms(spark):
    rows = spark.createDataFrame([("Contact-HoldNet (CHN)",), ("ab",), (None,)], "name string").select(mentions.name_forms(mentions.F.col("name")).alias("f")).collect()
    assert set(rows[0]["f"]) == {"contact-holdnet (chn)", "contact holdnet (chn)", "contactholdnet (chn)", "contact-holdnet-(chn)", "contact-hold net (chn)", "chn"} and rows[1]["f"] == []


def test_questions_name_whole_words_and_padded_names(spark):
    asked = [(1, "compare holdQP to holdVLA"), (2, "is WHN better than fox-net 2.0 now"), (3, "grasp things"), (4, "wide holding network?"), (5, None), (6, ""), (7, "the Fox-Net  2.0 one")]
    known = [("HoldQP",), ("HoldVLA",), ("Wide Holding Network (WHN)",), ("* Fox-Net 2.0",), ("of",), ("",)]
    got = mentions.named_in(spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame(known, "method string"))
    assert sorted(map(tuple, got.collect())) == [(1, "HoldQP"), (1, "HoldVLA"), (2, "* Fox-Net 2.0"), (2, "Wide Holding Network (WHN)")]
    assert mentions.named_in(spark.createDataFrame(asked, "query_id int, query string"), spark.createDataFrame([], "method string")).count() == 0


def test_header_clusters_are_those_of_the_sequential_loop(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["w%d" % rng.randrange(60), "rate", "Mean", "of"]) for _ in range(rng.randrange(4))) if i % 9 else None, 1 + i % 5) for i in range(260)]
    rows += [(300 + i, f"a{i} a{i + 1}", 1) for i in range(40)]  # a long chain
    clusters, want = [], {}
    for place, raw, _ in rows:
        own = set(re.findall("[a-z0-9]+", (raw or "").lower())) - set(headers.EMPTY_WORDS)
        at = next((c for c in clusters if own & c[1]), None)
        if at is None:
            clusters.append((place, set(own)))
            at = clusters[-1]
        at[1].update(own)
        want[place] = at[0]
    found = headers.header_clusters(spark.createDataFrame(rows, "place int, raw string, n int"))
    assert {r["place"]: r["cluster"] for r in found.collect()} == want
    best = headers.alias_proposals(found, most=5).collect()
    assert len(best) == 5 and [r["n"] for r in best] == sorted((r["n"] for r in best), reverse=True)


def test_phrases_are_counted_where_their_documents_lie(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = keyphrases.keyphrases(spark.createDataFrame([(1, "red ring red"), (2, "blue ring"), (3, None)], "doc_id long, text string"), 2)
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert not any("weights" in line for line in moved) and sum("doc_id" in line for line in moved) == 2  # its words and what they weigh
        assert sorted({r["doc_id"] for r in found.collect()}) == [1, 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_phrases_are_counted_in_steps_of_documents_and_sorted_as_they_are_read(spark, monkeypatch):
    import pyarrow as pa

    docs = [(i, [f"w{(i * j) % 5}" for j in range(i % 4 + 1)]) for i in range(1, 40)]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "words": w, "valued": [{"word": x, "idf": 1.0 + int(x[1:]) / 7} for x in sorted(set(w))]} for i, w in docs]).slice(3)

    def told():
        return [(doc, list(rows)) for doc, rows in keyphrases.ranked(batch, 3)]

    whole = told()
    monkeypatch.setattr(keyphrases, "STEP_WORDS", 3)
    assert told() == whole and [doc for doc, _ in whole] == [i for i, _ in docs[3:]]
    assert all([(-r, p) for p, r, _ in rows] == sorted((-r, p) for p, r, _ in rows) and rows[0][1] == 1.0 for _, rows in whole)
    plan = keyphrases.keyphrases(spark.createDataFrame([(1, "red ring")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "relevance" not in "".join(x for x in plan.splitlines() if "Sort [" in x)  # no row a phrase is sorted


def test_keyphrases_are_those_of_a_full_search(spark):
    rng = random.Random(9)
    words = ["grasp", "planner", "network", "depth", "the", "of", "camera", "point", "cloud", "loss", "a", "x1"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "the of a"), (93, "one")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {}
    for r in keyphrases.candidates(df).collect():
        rows.setdefault(r["doc_id"], []).append((r["phrase"], r["relevance"], {w["word"]: w["idf"] for w in r["weights"]}))
    n = len(texts)
    split = {i: [w for w in re.findall("[a-z0-9]{2,}", (t or "").lower()) if w not in keyphrases.STOP_WORDS] for i, t in texts}
    for i, own in rows.items():  # the weights themselves
        counts = {}
        for length, at in itertools.product((1, 2, 3), range(len(split[i]))):
            run = split[i][at : at + length]
            if len(run) == length == len(set(run)):
                counts[" ".join(run)] = counts.get(" ".join(run), 0) + 1
        raw = {p: math.log1p(c) * sum(math.log((1 + n) / (1 + sum(w in split[j] for j in split))) + 1 for w in p.split()) / len(p.split()) for p, c in counts.items()}
        assert {p: r for p, r, _ in own} == pytest.approx({p: x / max(raw.values()) for p, x in raw.items()}, abs=2e-6)
    got = {}
    for r in keyphrases.keyphrases(df).collect():
        got.setdefault(r["doc_id"], {})[r["place"]] = (r["phrase"], r["relevance"])
    for i, own in rows.items():
        left, chosen = sorted(own, key=lambda r: (-r[1], r[0])), []
        while left and len(chosen) < 10:
            best = max(left, key=lambda r: 0.5 * r[1] - 0.5 * max((keyphrases.alike(r[2], c[2]) for c in chosen), default=0.0))
            chosen.append(best)
            left.remove(best)
        assert [got[i][k] for k in sorted(got[i])] == [(c[0], c[1]) for c in chosen]
    assert set(got) == set(rows) and not {90, 91, 92} & set(got)


def test_outliers_are_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5)) + np.array([2, 0, 0, 0, 0])
    x[7] = x[8]
    x[9] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [1.0, float("nan"), 0.0, 0.0, 0.0]), (502, [1.0, 2.0]), (503, [1.0, None, 0.0, 0.0, 0.0])]
    got = {r["vec_id"]: r for r in retrieval.outliers(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)).collect()}
    length = np.linalg.norm(x, axis=1)
    u = x / np.where(length > 0, length, 1)[:, None]
    mean = ((u @ u.T).sum(axis=1) - (length > 0)) / 119
    assert sorted(got) == list(range(120))
    for i in got:
        assert got[i]["mean_similarity"] == pytest.approx(mean[i], abs=1e-6)
        assert got[i]["percentile"] == pytest.approx(100 * (mean > mean[i] + 1e-10).mean(), abs=0.06)
    assert retrieval.outliers(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
