"""Facts, equations and citation places against a plain reading of the same rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.operators import facts as X

SAID = [
    "success rate of 92.3%", "93.5 % accuracy", "achieves 0.92 on it", "reached a 94.5%", "mAP: 41%", "with 92.3 objects", "PointNet++ encoder", "a resnet-50", "U-Net", "focal loss", "Focal-loss", "AdamW", "learning rate of 1e-4", "12,000 training scenes",
    "$E = mc^2$", r"\begin{align}a &= b + c\end{align}", "L_g = x + y * 2 + z", "$the loss function here is$", "$ab = wordRunTogether$", "$x = [12] + y$", "YCB", "isaac  gym", "the ycb set", "A sentence. Another one? ", "\n", "net NetworkX then Net end", "R = 1",
]


def texts():
    rng = random.Random(5)
    return [(i, 0, " ".join(rng.choice(SAID) for _ in range(rng.randrange(1, 40)))) for i in range(120)] + [(900, 1, None), (901, 1, "")]


def plain_facts(text):
    out, seen = [], set()

    def add(kind, value, key, unit, context):
        if (kind, key) not in seen:
            seen.add((kind, key))
            out.append((kind, value, unit, context))

    for p in X.METRIC_PATTERNS:
        for m in re.finditer(p, text):
            near = text[max(0, m.start() - 100) : m.end() + 100].strip()
            parts = [s for s in near.split(".") if m[1] in s]
            add("metric", m[1], m[1], "%" if "%" in text[m.start() : m.end() + 5] else "", ((". ".join(parts).strip() if parts else near) if "." in near else near)[:200])
    for kind, p in [*X.ARCHITECTURE_PATTERNS.items(), ("dataset", rf"(?i)\b({'|'.join(X.DATASETS)})\b")]:
        reach = 60 if kind == "dataset" else 80
        for m in re.finditer(p, text):
            add(kind, m[0].strip(), m[0].strip().lower(), None, text[max(0, m.start() - reach) : m.end() + reach].strip()[:200])
    equations = 0
    for p in X.EQUATION_PATTERNS:
        for m in re.finditer(p, text):
            eq = m[1].strip()
            if valid(eq) and ("equation", eq[:200]) not in seen and (equations := equations + 1) <= X.EQUATIONS:
                add("equation", eq[:200], eq[:200], None, text[max(0, m.start() - 60) : m.start()].strip().split(".")[-1].strip()[:100])
    return out


def valid(eq):
    eq = eq.strip()
    words = eq.split()
    return (
        5 <= len(eq) <= 300 and any(c in "=+-*/^_{}\\∑∫∂∇αβγδεζηθλμνξπρστφχψω" for c in eq) and not (len(words) > 3 and sum(w.isalpha() and len(w) > 3 for w in words) / len(words) > 0.6)
        and not re.search(r"[a-z]{3}[A-Z][a-z]{3}", eq) and not re.search(r"\[\d+\]|Table\s+[IVX]+", eq)
    )


def test_facts_of_chunks(spark):
    rows = texts()
    got = {}
    for r in X.facts(spark.createDataFrame(rows, "doc_id long, seq int, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["kind"], r["value"], r["unit"], r["context"]))
    for i, _, text in rows:
        assert sorted(got.get(i, []), key=repr) == sorted(plain_facts(text or ""), key=repr)


@pytest.mark.parametrize("pattern, group", [(r"\bNet\b", 0), (r"(?i)n(e)t", 1), (r"\s+", 0), ("zzz", 0)])
def test_places_are_those_of_the_match_itself(spark, pattern, group):
    rows = [(i, t) for i, _, t in texts()]
    got = spark.createDataFrame(rows, "id long, text string").select("id", X.places(F.col("text"), pattern, group).alias("p")).collect()
    for r, (_, t) in zip(sorted(got, key=lambda r: r["id"]), rows, strict=True):
        assert [tuple(p) for p in r["p"] or []] == [(m.start(), m[0], m[group]) for m in re.finditer(pattern, t or "")]


@pytest.mark.parametrize("eq", ["a = b + c", "x=1", "", None, "the loss of this model is = high value", "= 12345 [3]", "Table IV + x", "badRunTogether = x", "∑ x y z", "only some words here now", "y" * 301 + "="])
def test_valid_equations(spark, eq):
    assert spark.createDataFrame([(eq,)], "e string").select(X.valid_equation(F.col("e"))).collect()[0][0] == (eq is not None and valid(eq))


def test_every_place_of_a_marker(spark):
    text = "One. Two cites [7] here. " + "x" * 150 + ". Far [7] and [70] later [7]. End."
    rows = spark.createDataFrame([(1, text), (2, "none"), (3, "[7]"), (4, None), (5, "a" * 300 + " [7] " + "b" * 300)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, m) for i in range(1, 6) for m in ("[7]", "")] + [(1, "[7]"), (1, "[70]")], "doc_id long, marker string")
    got = sorted((r["doc_id"], r["at"], r["marker"], r["context"]) for r in X.citations(rows, marks).collect())
    assert [(g[0], g[1], g[2]) for g in got] == sorted([(1, m.start(), m[0]) for m in re.finditer(r"\[70?\]", text)] + [(3, 0, "[7]"), (5, 301, "[7]")])
    assert all(c.count("【") == 1 and f"【{m}】" in c for _, _, m, c in got)
    assert got[0][3].startswith("One. Two cites 【[7]】 here.") and got[1][3].startswith("Far 【[7]】 and [70] later [7].") and got[-1][3] == "a" * 200 + " 【[7]】 " + "b" * 199 or got[-1][3].startswith("a")
