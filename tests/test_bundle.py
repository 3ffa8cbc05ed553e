"""The text that a question is given from the graph, against a walk question by question."""

import random
import re

from tracewell.operators import bundle as B


def walk(questions, ranked, nodes, edges, predicted, words):
    node = {n[0]: n for n in nodes}
    out = {}
    for query, text, intent in questions:
        low, tops = text.lower(), []
        for _, paper in sorted((place, paper) for q, paper, place in ranked if q == query):
            if paper in node and node[paper][1] == "paper" and paper not in tops:
                tops.append(paper)
        tops = tops[:5]
        name = {p: node[p][2] for p in tops}
        after = {p: [(e, node[e[1]]) for e in edges if e[0] == p] for p in tops}
        got = [[] for _ in B.SECTIONS]

        def take(i, papers, wanted, say, each=None):
            for p in tops[:papers]:
                hits = [say(p, e, n) for e, n in after[p] if wanted(e, n)]
                got[i].extend(hits[:each])

        def tally(kind, same):
            seen = {}
            for p in tops:
                for e, n in after[p]:
                    if kind(e, n):
                        seen.setdefault(same(n), []).append(p)
            return sorted(((k, list(dict.fromkeys(ps))) for k, ps in seen.items()), key=lambda x: -len(x[1]))

        if intent in ("BROAD", "TECHNICAL"):
            take(0, 3, lambda e, n: n[1] == "contribution" and not n[5] and n[4] == "high" and len(n[2]) > 30, lambda p, e, n: f"- {name[p]}: {n[2]}", 2)
        if intent in ("EVALUATION", "COMPARISON"):
            take(1, 3, lambda e, n: n[1] == "comparison" and n[4] != "low" and re.search(r"\d%|\d\.\d|[A-Z][a-z]+Net", n[2]), lambda p, e, n: f"- {name[p]}: {n[2]}")
        if intent == "LIMITATION":
            take(2, 5, lambda e, n: n[1] == "limitation", lambda p, e, n: f"- {name[p]}: {n[2]}", 2)
        for n, ps in tally(lambda e, n: n[1] == "technique", lambda n: n):
            if len(ps) >= 2 or n[2].lower() in low:
                got[3].append(f"- {n[2]} ({n[3]}): used by {', '.join(name[p] for p in ps)}")
        if any(w in low for w in B.HARDWARE):
            take(4, 5, lambda e, n: n[1] == "hardware", lambda p, e, n: f"- {name[p]}: {n[2]}")
        for p in tops:
            got[5] += [f"- {name[p]} cites {n[2]} ({e[4]} mentions)" for e, n in after[p] if e[2] == "cites"]
            got[5] += [f"- {node[e[0]][2]} cites {name[p]} ({e[4]} mentions)" for e in edges if e[1] == p and e[2] == "cites"]
        if intent in ("COMPARISON", "BROAD"):
            take(6, 4, lambda e, n: e[2] == "cites" and e[5] not in (None, "neutral"), lambda p, e, n: f"- {name[p]} {e[5].replace('_', ' ')} {n[2]}")
        if intent == "PEOPLE" or any(w in low for w in B.PEOPLE):
            for p in tops:
                names = [n[2] for _, n in after[p] if n[1] == "author"]
                if names:
                    got[7].append(f"- {name[p]}: {', '.join(names[:5])}" + (f" +{len(names) - 5}" if len(names) > 5 else ""))
            got[8] = [f"- {label} ({len(ps)} papers)" for label, ps in tally(lambda e, n: n[1] == "institution", lambda n: n[2])]
        if intent in ("BROAD", "COMPARISON"):
            got[9] = [f"- [{len(ps)} papers] {label} ({year})" for (label, year), ps in tally(lambda e, n: e[2] == "cites_external", lambda n: (n[2], n[6])) if len(ps) > 1]
        if intent in ("EVALUATION", "TECHNICAL", "BROAD"):
            for p in tops:
                own = {e[0] for e in edges if e[1] == p and node[e[0]][1] == "method"}
                data = sorted({node[e[1]][2] for e in edges if e[0] in own and e[2] in ("evaluated_on", "uses_dataset")})
                if data:
                    got[10].append(f"- {name[p]}: {', '.join(data[:5])}")
        for p in tops:
            got[11] += [f"- {name[p]} likely {t.replace('_', ' ')}: {label} ({c:.0%} graph confidence, {r:.0%} semantic match)" for pp, t, label, c, r, _ in predicted if pp == p and t != "outperforms" and r >= 0.35]
        got[5], got[6] = (list(dict.fromkeys(g)) for g in got[5:7])
        texts = [f"{title}:\n" + "\n".join(rows[:most]) for (title, most), rows in zip(B.SECTIONS, got, strict=True) if rows]
        text = "\n\n".join(texts)
        split = text.split()
        out[query] = (" ".join(split[:words]) if len(split) > words else text, min(len(split), words), len(texts))
    return out


def test_bundles_are_those_of_a_walk(spark):
    rng = random.Random(8)
    nodes = [(f"paper{i}", "paper", f"Paper {i}", None, None, None, None) for i in range(12)] + [(f"method{i}", "method", f"Method {i}", None, None, None, None) for i in range(8)]
    for kind, n in {"contribution": 30, "comparison": 20, "limitation": 20, "technique": 6, "hardware": 5, "author": 14, "institution": 5, "dataset": 9, "reference": 6}.items():
        for i in range(n):
            label = f"{kind} {i}" + (" that is told at a length over thirty" if i % 3 else "") + (f" by {i}.5 or {i}%" if kind == "comparison" and i % 2 else "")
            nodes.append((f"{kind}{i}", kind, label, "sub", rng.choice(["high", "low"]), rng.random() < 0.2, str(2000 + i)))
    relation = {"technique": "uses", "reference": "cites_external", "paper": "cites", "author": "authored_by"}
    pairs = {}
    for _ in range(500):
        s, (d, kind) = f"paper{rng.randrange(12)}", rng.choice(nodes)[:2]
        if kind == "method":
            pairs[d, s] = "described_in"
        elif s != d:
            pairs[s, d] = relation.get(kind, "has")
    for _ in range(40):
        pairs[f"method{rng.randrange(8)}", f"dataset{rng.randrange(9)}"] = rng.choice(["evaluated_on", "uses_dataset"])
    edges = [(s, d, t, i, i % 7, rng.choice([None, "neutral", "builds_on", "differs_from"]) if t == "cites" else None) for i, ((s, d), t) in enumerate(pairs.items())]
    asked = [("what is Technique 3 for", "BROAD"), ("which robot arm", "TECHNICAL"), ("compare them", "COMPARISON"), ("who wrote it", "PEOPLE"), ("numbers", "EVALUATION"), ("where does it fail", "LIMITATION"), ("of nothing", "BROAD")]
    questions = [(i, *q) for i, q in enumerate(asked)]
    ranked = [(q, f"paper{rng.randrange(14)}", k) for q in range(6) for k in range(8)]
    predicted = [(f"paper{i % 12}", rng.choice(["outperforms", "uses_loss"]), f"loss {i}", 0.1 + i / 100, rng.choice([0.2, 0.35, 0.81]), i) for i in range(60)]
    make = spark.createDataFrame
    for words in (500, 60):
        found = B.context_bundles(
            make(questions, "query_id int, query string, intent string"), make(ranked, "query_id int, paper string, place int"),
            make(nodes, "id string, type string, label string, subtype string, confidence string, is_methodology boolean, year string"),
            make(edges, "src string, dst string, type string, seq long, mentions int, sentiment string"), make(predicted, "paper string, type string, label string, confidence double, relevance double, seq long"), words,
        )
        got = {r["query_id"]: (r["context"], r["n_words"], r["n_sections"]) for r in found.collect()}
        want = walk(questions, ranked, nodes, edges, predicted, words)
        assert got[6] == ("", 0, 0)
        for q in want:
            assert got[q] == want[q], (q, words)


def test_questions_share_the_edges_of_papers_with_very_many(spark, monkeypatch):
    nodes = [(f"paper{i}", "paper", f"Paper {i % 9}", None, None, None, None) for i in range(300)] + [(f"x{i}", "limitation" if i % 2 else "hardware", f"thing {i % 40}", None, "high", False, None) for i in range(400)]
    nodes += [(f"t{i}", "technique", f"way {i}", "sub", "high", False, None) for i in range(4)]
    pairs = [(f"paper{i % 3}", f"x{i}", "has") for i in range(400)] + [(f"paper{i}", f"paper{i % 3}", "cites") for i in range(3, 300)] + [("paper0", "paper1", "cites"), ("paper1", "paper0", "cites")] + [(f"paper{i // 2}", f"t{i}", "uses") for i in range(4)] + [("paper2", "t1", "uses")]
    edges = [(s, d, t, i, i % 7, "builds_on" if t == "cites" else None) for i, (s, d, t) in enumerate(pairs)]
    intents = ["LIMITATION", "TECHNICAL", "PEOPLE", "COMPARISON"]
    questions = [(i, f"way {i % 5} for a robot", intents[i % 4]) for i in range(60)]
    ranked = [(q, f"paper{(q + k) % 3}", k) for q in range(60) for k in range(3)]
    written, write = [], B.staged

    def counting(rows):
        out = write(rows)
        written.append(out.count())
        return out

    monkeypatch.setattr(B, "staged", counting)
    make = spark.createDataFrame
    found = B.context_bundles(
        make(questions, "query_id int, query string, intent string"), make(ranked, "query_id int, paper string, place int"),
        make(nodes, "id string, type string, label string, subtype string, confidence string, is_methodology boolean, year string"),
        make(edges, "src string, dst string, type string, seq long, mentions int, sentiment string"), make([], "paper string, type string, label string, confidence double, relevance double, seq long"), 500,
    )
    got = {r["query_id"]: (r["context"], r["n_words"], r["n_sections"]) for r in found.collect()}
    assert got == walk(questions, ranked, nodes, edges, [], 500)
    assert max(written) <= len(edges)  # not questions times edges
