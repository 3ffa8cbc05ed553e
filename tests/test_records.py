"""Records of many tables: how they are dealt to tasks and what is sorted."""

from tracewell.operators import records as R

METRICS = [{"id": "success_rate", "aliases": ["Success Rate"], "unit": "%", "higher_is_better": True, "type": "rate"}]


def test_records_are_dealt_by_the_number_of_rows_and_sorted_before_cells_are_read(spark, monkeypatch):
    rows = [(t, r, [f"m{r}", str(r * t), "n/a"]) for t in range(40) for r in range(1, 6)] + [(t, 0, ["Method", "Success Rate", "Size"]) for t in range(40)] + [(None, 1, ["lost"])]
    rows, tables = spark.createDataFrame(rows, "table_id int, row int, cells array<string>"), spark.createDataFrame([(t, f"p{t}", "Table") for t in range(39)], "table_id int, paper string, caption string")
    monkeypatch.setattr(R, "ROWS", 10)
    found = R.records_from_rows(rows, tables, METRICS, [])
    assert sorted((r["paper"], r["row"], r["col"], r["value"], r["metric"], r["unit"], r["caption"]) for r in found.collect()) == sorted((f"p{t}", r, 1, float(r * t), "success_rate", "%", "Table") for t in range(39) for r in range(1, 6))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 24), REPARTITION_BY_NUM" in plan  # 240 rows, ten a task
    lines = plan[plan.index("Initial Plan") if "Initial Plan" in plan else 0 :].splitlines()
    reads = max(i for i, x in enumerate(lines) if "Generate explode" in x)
    assert not [x for x in lines[:reads] if "Sort [" in x]  # records themselves, many times the size of the cells, are not sorted


def test_headers_captions_and_labels_are_settled_once_or_where_they_lie_with_the_same_rows(spark, monkeypatch):
    lines = [(0, ["Method", "Planning Time", "Planning Time", "", "real robot GSR"]), (1, ["", "mean (ms)", "max (s)", "", "piled"]), (1, ["", "", "", "x", ""]), (2, ["Ours [3]", "4", "5 ± 1", "6", "0.5"]), (2, ["more", "", "7", "", ""]), (3, ["name", "8", "9", "1", "2"])]
    rows = spark.createDataFrame([(t, r, cells) for t in (1, 2, 3) for r, cells in lines], "table_id int, row int, cells array<string>")
    tables = spark.createDataFrame([(1, "p", "Results in simulation on YCB"), (2, "q", None), (3, "r", "packed scenes, zero-shot")], "table_id int, paper string, caption string")
    metrics, conditions = [{"id": "success_rate", "aliases": ["GSR"], "type": "rate"}, {"id": "latency", "aliases": ["time"], "unit": "ms"}], [{"id": "pile", "aliases": ["piled"]}]

    def told(protocol):
        found = R.normalised(R.records_from_rows(rows, tables, metrics, conditions, protocol), metrics, {})
        return found, sorted(map(repr, found.collect()))

    settled, known = told(True)
    lines = settled._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in lines[: min(i for i, x in enumerate(lines) if "Window" in x)] if "isaac" in x and "Broadcast" not in x and "FileScan" not in x and "caption_places" not in x]  # records do not meet the patterns of protocols
    plain = told(False)[1]
    monkeypatch.setattr(R, "FEW", 0)
    assert known == plain == told(True)[1] == told(False)[1] and len(known) > 20


def test_labels_of_published_records_are_settled_once(spark, monkeypatch):
    rows = [("Base", "Base", "p", 1, r, 2, m, raw, float(r)) for r, (m, raw) in enumerate([("sr", "Success"), (None, "time (ms)"), (None, "pile"), (None, "time (ms)"), (None, None)])]
    told = spark.createDataFrame(rows, "method_raw string, mention string, paper string, table_id long, row int, col int, metric string, metric_raw string, value double")
    told = told.selectExpr("*", "CAST(NULL AS STRING) AS condition", "CAST(NULL AS DOUBLE) AS deviation", "'%' AS unit", "true AS higher_is_better", "false AS is_own")
    resolved = spark.createDataFrame([("Base", "BaseNet", "high")], "mention string, method string, confidence string")
    found = R.published(told, resolved)
    plan = found._jdf.queryExecution().executedPlan().toString()
    broadcast = plan[plan.index("BroadcastExchange") :]
    assert plan.count("declutter") == broadcast.count("declutter") > 0  # labels meet their patterns before they meet records
    once = sorted(map(repr, found.collect()))
    monkeypatch.setattr(R, "FEW", 0)
    assert once == sorted(map(repr, R.published(told, resolved).collect())) and len(once) == 3


def test_compiled_steps_read_cells_as_the_expression_does(spark):
    from pyspark.sql import functions as F

    from tracewell.functions import labels as L

    cells = ["85 . 3 ± 2 . 1", "7ms 30ms 66ms", "93%", "—", "(12)", "-4", "0.93", " 5 ", "", None, "n/a", "4 ± 1 %", "± 3", "1.", "-", "1 (2) ± 3", "x", "12 . 5 (3)", "%", "1e5", "５"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, text string")
    want = rows.select("id", L.parsed_cell(F.col("text")).alias("c")).where("c.value IS NOT NULL").select("id", "c.*")
    assert sorted(L.with_parsed(rows, "text").select("id", "cell.*").collect()) == sorted(want.collect())


def test_places_of_protocol_axes_give_their_tokens(spark):
    from pyspark.sql import functions as F

    from tracewell.functions import labels as L

    heads, captions = [["simulated"], ["in the real | world"], ["YCB", "real robot"], ["in the real", "world"], []], [None, "EGAD, fixed camera", "pybullet; zero-shot", "real-world runs, random view", "gauss"]
    rows = spark.createDataFrame([(h, c) for h in heads for c in captions], "heads array<string>, caption string")
    places = F.when(F.size("heads") > 0, L.least_places(F.transform("heads", L.protocol_places)))
    told = rows.select(L.protocol_tokens(F.array_join("heads", " | "), F.col("caption")).alias("a"), L.tokens_at(places, L.protocol_places(F.coalesce("caption", F.lit("")))).alias("b"))
    assert all(r["a"] == r["b"] for r in told.collect())


def test_sequences_of_header_rows_are_settled_once(spark):
    rows = [(t, r, cells) for t in range(6) for r, cells in [(0, ["Method", "Success Rate", "Size"]), (1, ["", "(%)", ""]), (2, [f"m{t}", "1", "2"]), (2, ["twice", "3", "4"])]] + [(7, 0, ["Method", "Success Rate", "n"]), (7, 0, ["", "(%)", ""]), (7, 5, ["m", "5", "6"])]
    rows, metrics = spark.createDataFrame(rows, "table_id int, row int, cells array<string>"), [{"id": "success_rate", "aliases": ["Success Rate"]}]
    headings, shapes = R._headings(rows, metrics, [], False)
    assert headings.count() == 3 and sorted(len(r["shape"]) for r in shapes.collect()) == [2, 2]  # six tables, one sequence
    tables = spark.createDataFrame([(t, "p", "c") for t in range(8)], "table_id int, paper string, caption string")
    got = sorted((r["table_id"], r["mention"], r["metric_raw"], r["value"]) for r in R.records_from_rows(rows, tables, metrics, []).collect())
    twice = [(t, m, f, v) for t in range(6) for m in (f"m{t}", "twice") for f, vs in (("Success Rate | (%)", (1.0, 3.0)), ("Size", (2.0, 4.0))) for v in vs]
    assert got == sorted([*twice, (7, "m", "(%) | Success Rate", 5.0), (7, "m", "n", 6.0)])  # two rows of one number are one, whose labels go by their letters
