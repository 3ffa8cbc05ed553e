"""Conflicts of claims against a walk over all pairs of claims."""

import random
from itertools import product

from tracewell.operators import kg as K

WORDS = ["grip", "arm", "pile", "slow", "fast", "noise", "depth", "the", "of", "light"]


def test_claim_conflicts_pair_only_papers_that_claim(spark, monkeypatch):
    rng = random.Random(7)
    claims = [(i, f"p{rng.randrange(6)}", rng.choice(["limitation", "contribution", "comparison", "note"]), " ".join(rng.choices(WORDS, k=rng.randrange(1, 8)))) for i in range(150)]
    claims += [(150 + i, f"p{i % 6}", "limitation" if i % 2 else "comparison", "Slow  arm of the pile") for i in range(40)] + [(190, "p1", "limitation", None), (191, "p9", "limitation", "slow arm pile")]
    edges = [(f"p{i}", f"t{t}", "uses_technique") for i in range(400) for t in ({0, i % 3} if i not in (4, 5) else {i})] + [("p4", "t0", "cites"), ("p5", "t4", "uses_technique")]
    paired, meet = [], K.met

    def counting(rows, item, key):
        paired.append(rows.select(key).distinct().count())
        return meet(rows, item, key)

    monkeypatch.setattr(K, "met", counting)
    found = K.claim_conflicts(spark.createDataFrame(claims, "claim_id long, paper string, kind string, value string"), spark.createDataFrame(edges, "src string, dst string, type string")).collect()
    uses, best = {}, {}
    for src, dst, kind in edges:
        if kind == "uses_technique":
            uses.setdefault(src, set()).add(dst)
    words = {c: set((value or "").lower().split()) - set(K.STOP_WORDS) for c, _, _, value in claims}
    for (i, a, kind, _), (j, b, other, _) in product(claims, claims):
        shared = len(words[i] & words[j])
        if kind == "limitation" and other in ("contribution", "comparison") and a != b and uses[a] & uses[b] and shared >= 3:
            best[a, b] = min(best.get((a, b), (0, 0, 0)), (-shared, i, j))
    assert {(r["paper_a"], r["paper_b"]): (-r["shared"], r["limitation"], r["claim"]) for r in found} == best
    assert len(best) > 10 and paired == [7]  # of 400 papers with techniques


def test_papers_of_equal_titles_meet_methods_once(spark):
    papers = [(f"p{i:04}", f"On Gripping {i % 3}" if i % 2 else "ring bolt") for i in range(2000)] + [("q", None), ("p", "Ring  Bolt!")]
    found = K.method_papers(spark.createDataFrame([("ring bolt",), ("gripping 1",), ("fixed",), ("none",), ("gripping",)], "method string"), spark.createDataFrame(papers, "paper string, title string"), spark.createDataFrame([("fixed", "o")], "method string, paper string"))
    rows = sorted(map(tuple, found.collect()))
    assert rows == [("fixed", "o", "override"), ("gripping", "p0001", "words"), ("gripping 1", "p0001", "words"), ("none", None, None), ("ring bolt", "p", "slug")]
    assert "keys=[title#" in found._jdf.queryExecution().optimizedPlan().toString() or "Aggregate [title#" in found._jdf.queryExecution().optimizedPlan().toString()
