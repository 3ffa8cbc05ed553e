"""Rules of the core operators on small cases, and file sources."""

import difflib
import itertools

import pytest
from pyspark.sql import functions as F

from tracewell.functions import labels as L
from tracewell.functions import prose as P
from tracewell.functions import text as X
from tracewell.operators import browse, evidence, kg, records, relational, resolution, retrieval
from tracewell.sources import config, files


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    ("cell", "want"),
    [('red, "small, blue" ring', ["red", "small, blue ring"]), ('a,,b', ["a", "b"]), ('"say ""hi""", x', ['say "hi"', "x"]), ("", []), ('  "a,b"  ', ["a,b"]), ("one", ["one"])],
)
def test_smart_split(spark, cell, want):
    assert one(spark, relational.smart_split(F.col("c")), c=cell) == want


def test_filter_patterns_keep_their_classes(spark):
    df = spark.createDataFrame([("A1",), ("b",), ("7",)], "x string")
    assert [r[0] for r in relational.filter_and_count(df, {"x": r"^\D$"}).collect()] == ["b"]
    assert [r[0] for r in relational.filter_and_count(df, {"x": "^a"}).collect()] == ["A1"]


def test_attribute_filter_needs_two_rows(spark):
    df = spark.createDataFrame([("red", "big"), ("red", "small"), ("blue", "big")], "c string, s string")
    assert relational.attribute_filter(df, "red ones", ("c", "s")).count() == 2
    assert relational.attribute_filter(df, "blue ones", ("c", "s")).count() == 0 and relational.attribute_filter(df, "none", ("c", "s")).count() == 0


def test_corrections_look_at_all_of_the_vocabulary(spark):
    vocabulary = spark.createDataFrame([("convolution",), ("grasp",), ("net",)], "word string")
    words = spark.createDataFrame([("xonvolution",), ("Grsp",), ("NEX",), ("grasp",), ("faraway",)], "word string")
    assert {r["word"]: r["fixed"] for r in resolution.corrected(words, vocabulary).collect()} == {"xonvolution": "convolution", "Grsp": "Grasp", "NEX": "NET"}


def test_stem_takes_any_column(spark):
    assert [one(spark, X.stem(F.col("anything")), anything=w) for w in ("grasping", "studies", "planned", "boxes", "grasps", "class")] == ["grasp", "study", "plann", "box", "grasp", "class"]


def test_near_chunks_contained_in_better_ones_go(spark):
    rows = [(1, 0, "Alpha beta gamma delta", 2.0, "mid"), (1, 1, "beta gamma", 1.0, "mid"), (1, 2, "ALPHA, beta gamma; delta", 2.0, "fine"), (1, 3, "δδδ", 1.0, "mid"), (1, 4, "λλ", 1.0, "mid"), (2, 0, "beta gamma", 1.0, "mid")]
    kept = retrieval.suppress_near(spark.createDataFrame(rows, "doc_id int, seq int, text string, score double, layer string"))
    assert sorted((r["doc_id"], r["seq"]) for r in kept.collect()) == [(1, 2), (1, 3), (1, 4), (2, 0)]


def test_near_chunks_offer_only_what_others_begin_with(spark):
    rows = spark.createDataFrame([(1, 0, "alpha beta gamma", 2.0, "mid"), (1, 1, "beta gamma", 1.0, "mid"), (2, 0, "beta", 1.0, "mid")], "doc_id int, seq int, text string, score double, layer string")
    found = retrieval.suppress_near(rows)
    assert "array_intersect" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["doc_id"], r["seq"]) for r in found.collect()) == [(1, 0), (2, 0)]


def test_neighbours_skip_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [1.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r["query_id"], r["vec_id"]) for r in retrieval.nearest(v, v, 3).collect()) == [(1, 2), (2, 1)]


def test_gaps_count_methods_of_a_cell(spark):
    rows = [("m", "c", "a", "p1"), ("m", "c", "b", "p2"), ("m", "d", "a", "p1"), ("m", "d", "a", "p2")]
    found = evidence.coverage_gaps(spark.createDataFrame(rows, "metric string, condition string, method string, paper string"))
    assert [(r["condition"], r["n_methods"]) for r in found.collect()] == [("d", 1)]


def test_cell_values(spark):
    got = {c: tuple(spark.range(1).select(*[x.alias(str(i)) for i, x in enumerate(L.cell_value(F.lit(c)))]).first()) for c in ("85 . 3 ± 2 . 1", "7ms 30ms 66ms", "93%", "—", "(12)", "-4", "0.93")}
    assert got == {"85 . 3 ± 2 . 1": (85.3, 2.1, None), "7ms 30ms 66ms": (None, None, None), "93%": (93.0, None, "%"), "—": (None, None, None), "(12)": (12.0, None, None), "-4": (-4.0, None, None), "0.93": (0.93, None, None)}


def test_records_move_the_cells_of_a_table_once(spark):
    lines = [(0, ["#", "Method", "Success Rate (%)", "time"]), (1, ["1", "Ours [3]", "93", "7ms"]), (2, ["2", "average", "1", "2"]), (3, ["3", "Base", "-", "4 ± 1"]), (3, ["3", "Base", "5", ""])]
    rows = spark.createDataFrame([(1, row, cells) for row, cells in lines], "table_id long, row int, cells array<string>")
    cells = spark.createDataFrame([(1, row, col, text) for row, texts in lines for col, text in enumerate(texts)], "table_id long, row int, col int, text string")
    tables = spark.createDataFrame([(1, "p", "Table 2")], "table_id long, paper string, caption string")
    metrics = [{"id": "sr", "aliases": ["Success Rate"], "unit": "%"}, {"id": "latency", "aliases": ["time"], "unit": "s"}]
    for found in (records.records_from_cells(cells, tables, metrics, []), records.records_from_rows(rows, tables, metrics, [])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 2  # the cells and the tables
        got = sorted((r["row"], r["col"], r["mention"], r["metric"], r["value"], r["deviation"]) for r in found.collect())
        assert got == [(1, 2, "Ours", "sr", 93.0, None), (1, 3, "Ours", "latency", 7.0, None)] + [(3, 2, "Base", "sr", 5.0, None)] * 2 + [(3, 3, "Base", "latency", 4.0, 1.0)] * 2


def test_chunks_keep_vertical_tabs_in_words_and_lose_wide_spaces_around_as_in_sql(spark):
    long = " ".join(f"worded{i}." for i in range(16))
    assert one(spark, P.valid_chunk(F.col("t")), t=long) and not one(spark, P.valid_chunk(F.col("t")), t=long.replace(" ", "\x0b", 1))
    short = "\u3000" * 60 + "ab cde " * 3 + "longer " * 13 + "\xa0"
    assert one(spark, F.length(P.bare(F.col("t"))), t=short) == len(short.strip("\u3000\xa0 ")) and one(spark, P.bare(F.col("t")), t="\t a\n\u3000") == "\t a\n"


def test_words_begin_after_letters_with_accents_as_in_sql(spark):
    names = "IERQUE!! LERÉEUX!! ÉREOUPA!! ÉANELLEOU!! ÈAN!! ÉANVIIER,!! ÈOUEUX!! IERTION!! PATION!! {} Ann Bee * Carl Dee * MIT Lab"
    assert one(spark, P.valid_chunk(F.col("t")), t=names.format("ÉAN")) and not one(spark, P.valid_chunk(F.col("t")), t=names.format("ÉXN"))  # "an " is a word of a sentence there
    assert one(spark, P.valid_chunk(F.col("t")), t=names.format("İS")) and one(spark, P.sentiment(F.col("t")), t="éfollows") == "builds_on"
    assert one(spark, X.role(F.col("t"), P.ROLES, "general"), t="là éwe propose") == "algorithm_description" and one(spark, P.topics(F.col("t"), ("grasp",)), t="graspé") == ["grasp"]


def test_published_records_move_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = [("Base [1]", "Base", "p", 1, 1, 2, "sr", "Success", 1.0), ("Base [1]", "Base", "q", 2, 1, 2, "sr", "Success", 2.0), ("10 K", "10 K", "p", 1, 2, 2, "sr", "Success", 3.0), ("Our-Net", "ours", "p", 1, 3, 2, None, "time (ms)", 4.0), ("Base [1]", "Base", "p", 1, 1, 3, None, "?", 5.0)]
        told = spark.createDataFrame(rows, "method_raw string, mention string, paper string, table_id long, row int, col int, metric string, metric_raw string, value double")
        told = told.withColumns({"condition": F.lit(None).cast("string"), "deviation": F.lit(None).cast("double"), "unit": F.lit("%"), "higher_is_better": F.lit(True), "is_own": F.lit(False)}).repartition(3)
        resolved = spark.createDataFrame([("Base", "BaseNet", "high"), ("other", "OurNet", "low"), ("ours", None, "low")], "mention string, method string, confidence string")
        found = records.published(told, resolved)
        lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
        assert sum("Exchange hashpartitioning" in a and "table_id" in b for a, b in zip(lines, lines[1:])) == 1
        assert sorted((r["table_id"], r["row"], r["method"], r["comparable"], r["confidence"]) for r in found.collect()) == [(1, 1, "BaseNet", True, "high"), (1, 3, "OurNet", False, "low"), (2, 1, "BaseNet", True, "high")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_method_names(spark):
    good, bad = ["S4G", "π 0 (fine-tuned)", "6-DoF GraspNet"], ["+ CollisionNet", "w/o refinement", "( 0 , 0 , 10 )", "10 K", "10N", "5 ms", "x"]
    assert all(one(spark, L.valid_method_name(F.col("n")), n=n) for n in good) and not any(one(spark, L.valid_method_name(F.col("n")), n=n) for n in bad)
    assert [one(spark, L.method_name(F.col("n")), n=n) for n in ("2 GPT4-Vision", "12. AnyGrasp [3, 5]", "3DAPNet†", "Lee et al. net")] == ["GPT4-Vision", "AnyGrasp", "3DAPNet", "Lee net"]


def test_cascade_steals_no_identity(spark):
    methods = spark.createDataFrame([("PointNetGPD", 0), ("GPD", 1), ("Contact-GraspNet", 2), ("Region Net", 3)], "method string, place int")
    aliases = spark.createDataFrame([("CGN", "Contact-GraspNet")], "alias string, method string")
    asked = ["gpd", "cgn", "ContactGraspNet", "our Contact GraspNet (ours)", "reg", "42", "[12]", "region"]
    got = {r["mention"]: (r["method"], r["confidence"]) for r in records.method_cascade(spark.createDataFrame([(a,) for a in asked], "mention string"), methods, aliases).collect()}
    assert got == {
        "gpd": ("GPD", "high"), "cgn": ("Contact-GraspNet", "high"), "ContactGraspNet": ("Contact-GraspNet", "high"), "our Contact GraspNet (ours)": ("Contact-GraspNet", "medium"),
        "reg": (None, "low"), "42": (None, "low"), "[12]": (None, "low"), "region": ("Region Net", "medium"),
    }


def test_mentions_name_every_method_but_no_part_of_one(spark):
    methods = spark.createDataFrame([("Contact-GraspNet",), ("GraspNet",), ("Grasp Pose Detection (GPD)",)], "method string")
    said = ["it outperforms Contact-GraspNet and GPD by 5%", "gpddata only", "GraspNet alone"]
    got = {(r["mention"], r["method"]) for r in records.methods_mentioned(spark.createDataFrame([(x,) for x in said], "mention string"), methods).collect()}
    assert got == {(said[0], "Contact-GraspNet"), (said[0], "Grasp Pose Detection (GPD)"), (said[2], "GraspNet")}


def test_copied_captions(spark):
    caption = "Results except Almond and Azure are from [20]"
    assert [one(spark, L.caption_copied(F.col("m"), F.lit(caption)), m=m) for m in ("Almond", "EquiAlmond", "azure 2", "Other")] == [False, True, False, True]
    assert [one(spark, L.copy_status(F.col("c")), c=c) for c in ("as in [5]", "the results are from [9].", "'*' denotes the results are from [2]")] == [None, "all", "ambiguous"]


def test_valid_chunks(spark):
    prose = "We place the gripper above the object and close it slowly, which keeps the contact stable for most of the scenes."
    bad = ["too short.", "ann@example.org bob@example.org " * 9, "a b c d e f " * 4, "Ann Bee * Carl Dee * Edna Foe * Gus Hill * MIT Lab Of Things And More Names Here Now Again And."]
    assert one(spark, P.valid_chunk(F.col("t")), t=prose) and not any(one(spark, P.valid_chunk(F.col("t")), t=t) for t in bad)


def test_citation_contexts_snap_to_sentences(spark):
    text = "raining data. " * 20 + "We extend the planner of Lee [7] with a second stage. " + "More follows here. " * 20
    got = one(spark, P.citation_context(F.col("t"), F.lit("[7]")), t=text)
    assert "【[7]】" in got and got.startswith("raining data.") and got.endswith(".") and len(got) < 420


def test_title_matches_against_brute_force(spark):
    titles = ["a study of nets", "nets of a study", "another paper", "A Study of Nets and more", ""]
    rows = [(x, y, None, "") for x, y in itertools.product(titles, titles)]

    def ratio(x, y):
        one, two = set(x.lower().split()), set(y.lower().split())
        if not one or not two:
            return 0.0
        parts = [" ".join(sorted(one & two)), *(" ".join([*sorted(one & two), *sorted(own)]) for own in (one - two, two - one))]
        return max(difflib.SequenceMatcher(None, a, b).ratio() for a, b in itertools.combinations(parts, 2))

    got = browse.verified_matches(spark.createDataFrame(rows, "title string, candidate string, surname string, authors string")).collect()
    assert {(r["title"], r["candidate"]) for r in got} == {(x, y) for x, y, _, _ in rows if ratio(x, y) >= 0.85}


def test_clusters_are_bounded_by_a_third(spark):
    rows = [(i, [float(i % 2) * 10, 0.1 * i]) for i in range(7)]
    found = browse.clustered(spark.createDataFrame(rows, "id long, vector array<double>"), 6).collect()
    assert len(found) == 7 and len({r["cluster"] for r in found}) == 2
    assert len({(r["id"] % 2, r["cluster"]) for r in found}) == 2


TEI = """<TEI><teiHeader><fileDesc><sourceDesc><biblStruct><analytic>
<author><persName><forename>Ánn</forename><surname>Bee</surname></persName><affiliation><orgName type="department">Lab</orgName><orgName type="institution">Uni</orgName></affiliation></author>
<author><persName><forename>Ann</forename><surname>Bee</surname></persName></author><author><persName><surname>12 345</surname></persName></author><author><persName><forename>Carl</forename><surname>Dee</surname></persName></author>
</analytic></biblStruct></sourceDesc></fileDesc></teiHeader><text><body>
<div><head>Results on piles</head><figure type="table"><head>Table 1</head><figDesc>Runs</figDesc><table><row><cell>Method</cell><cell>Success</cell></row><row><cell>A</cell><cell>3</cell></row></table></figure></div>
<div><head>Ablating</head><figure type="table"><head>Table 2</head><table><row><cell>x</cell></row></table></figure><figure type="image"><head>f</head></figure></div></body>
<back><listBibl><biblStruct xml:id="b0"><analytic><title level="a" type="main">On nets</title><author><persName><forename>Bo</forename><surname>Lee</surname></persName></author></analytic><monogr><title level="j">Journal</title><imprint><date when="2019-03"/></imprint></monogr><idno type="DOI">10.1/x</idno></biblStruct></listBibl></back></text></TEI>"""


def test_structured_documents(spark, tmp_path):
    (tmp_path / "one.tei.xml").write_text(TEI)
    tables = {r["caption"]: r for r in files.read_sections(spark, str(tmp_path), ("results",), ("ablation",)).collect()}
    assert {c: (r["paper"], r["section"], r["is_results"], r["is_ablation"]) for c, r in tables.items()} == {"Runs": ("one", "Results on piles", True, False), "Table 2": ("one", "Ablating", False, True)}
    assert tables["Runs"]["rows"] == [["Method", "Success"], ["A", "3"]]
    authors = files.read_authors(spark, str(tmp_path)).where("institution IS NOT NULL OR name LIKE 'Carl%'").orderBy("place").collect()
    assert [(r["name"], r["affiliation"], r["institution"]) for r in authors] == [("Ánn Bee", "Lab, Uni", "Uni"), ("Carl Dee", "", None)]
    entry, = files.read_bibliography(spark, str(tmp_path)).collect()
    assert tuple(entry) == ("one", "b0", "On nets", "2019", ["Lee, B."], "10.1/x", None, "Journal")


def test_guarded_write_keeps_a_whole_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert files.guarded_write(spark.range(5), path) and files.guarded_write(spark.range(7), path)
    assert not files.guarded_write(spark.range(0), path) and spark.read.parquet(path).count() == 7
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_rows_and_artifacts(spark, tmp_path):
    (tmp_path / "m.csv").write_text('Citation,NAME \nx,"a\nb"\ny,\n')
    assert [tuple(r) for r in files.read_rows(spark, str(tmp_path / "m.csv")).collect()] == [("a\nb", "x", "")]
    nodes = spark.createDataFrame([("a", "paper", "A"), ("b", "paper", "B"), ("c", "chunk", "C")], "id string, type string, label string")
    edges = spark.createDataFrame([("a", "b", "cites"), ("a", "b", "cites"), ("a", "c", "has")], "src string, dst string, type string")
    made = files.graph_artifacts(nodes, edges, ("paper",))
    assert all(files.export_artifacts(made, f"file://{tmp_path}/graph").values())
    assert {(r["id"], r["degree"]) for r in spark.read.parquet(f"file://{tmp_path}/graph/macro_nodes").collect()} == {("a", 1), ("b", 1)}
    assert spark.read.parquet(f"file://{tmp_path}/graph/macro_edges").count() == 1


def test_folded_names(spark):
    assert one(spark, kg.folded(F.col("n")), n="  Ánn-Bée, ß 3 ") == "ann bee 3"


def test_acronyms_of_three_forms(spark):
    texts = ["We use the Convolutional Neural Network (CNN) here", "a CNN (Compact Neural Net) and GPD, or Grasp Pose Detection, too", "nothing of it (ABC) here"]
    found = {(r["acronym"], r["full_form"], r["n"]) for r in resolution.acronyms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert found == {("CNN", "Convolutional Neural Network", 2), ("GPD", "Grasp Pose Detection", 1)}


def test_configuration_is_checked():
    good = {"domain": "d", "display_name": "D", "csv_path": "x.csv", "columns": {"Name": {"role": "method.name"}, "Arm": {"role": "hardware"}, "Note": {}}}
    assert config.columns_by_role(good) == {"method.name": ["Name"], "hardware": ["Arm"]}
    for bad in ({**good, "csv_path": ""}, {**good, "columns": {"Arm": {"role": "hardware"}}}, {**good, "facets": ["colour"]}):
        with pytest.raises(config.ConfigError):
            config.columns_by_role(bad)
    with pytest.raises(config.ConfigError):
        config.columns_by_role(good, {"method.name"})


def test_hub_items_meet_every_pair_once(spark):
    rows = [(i, k) for i in range(3) for k in range(40 if i == 0 else 5)]
    pairs = relational.met(spark.createDataFrame(rows, "item int, key int"), "item", "key", block=7).collect()
    assert sorted(tuple(r) for r in pairs) == sorted((i, a, b) for i in range(3) for a, b in itertools.combinations(range(40 if i == 0 else 5), 2))


def merged_by_loop(groups, least, most):
    """Group after group, as read from the rules: fit, absorb, close, cut, and what is left over."""
    packs, held, tokens = [], [], 0
    for seq, sizes in groups:
        if tokens + sum(sizes) <= most:
            held += [(seq, i) for i in range(len(sizes))]
            tokens += sum(sizes)
            continue
        if held and tokens < least:
            held += [(seq, i) for i in range(len(sizes))]
            tokens += sum(sizes)
            if tokens >= least:
                packs.append(held)
                held, tokens = [], 0
            continue
        if held:
            packs.append(held)
        held, tokens = [], 0
        for i, n in enumerate(sizes):
            if sum(sizes) > most and held and tokens + n > most:
                packs.append(held)
                held, tokens = [], 0
            held.append((seq, i))
            tokens += n
    if held and (tokens >= least or not packs):
        packs.append(held)
    elif held:
        packs[-1] = packs[-1] + held
    return packs


def test_groups_are_absorbed_cut_and_flushed(spark):
    import random

    from tracewell.operators.resolution import merged_groups

    rng = random.Random(6)
    docs = {d: [(seq, [rng.choice([1, 3, 8, 30]) for _ in range(rng.randrange(1, 7))]) for seq in range(rng.randrange(1, 14))] for d in range(60)}
    docs |= {100: [(0, [2])], 101: [(0, [50, 50, 50])], 102: [(0, [1]), (1, [60, 1]), (2, [1])], 103: [(0, [])]}
    df = spark.createDataFrame([(d, seq, sizes) for d, gs in docs.items() for seq, sizes in gs], "doc_id long, seq int, sizes array<int>")
    got = {}
    for r in merged_groups(df, 12, 40).collect():
        got.setdefault(r["doc_id"], {}).setdefault(r["pack"], []).append((r["seq"], r["sentence"]))
    for d, gs in docs.items():
        want = merged_by_loop([g for g in gs if g[1]], 12, 40)
        assert [sorted(got.get(d, {})[n]) for n in range(len(got.get(d, {})))] == want


def test_answers_that_are_cut_off_or_odd(spark):
    from tracewell.operators import browse

    rows = [(1, '[{"type": "loss", "value": "long enough"}'), (2, "no list"), (3, None), (4, '[{"type": "loss"}, 3, {"type": "loss", "value": "long enough"}]'), (5, "```\n[]\n```")]
    got = browse.parsed_entities(spark.createDataFrame(rows, "answer_id int, answer string"), ("loss",)).collect()
    assert {r["answer_id"] for r in got} <= {4}
    said = [(1, '{"answer": "yes", "citations": [null, {"paper_id": "p"}]}'), (2, '{"answer": 3}'), (3, '{"answer": ""}'), (4, "}{"), (5, None), (6, '{"answer": "cut')]
    told = {r["answer_id"]: r for r in browse.structured_answers(spark.createDataFrame(said, "answer_id int, answer string")).collect()}
    assert told[1]["answer"] == "yes" and told[1]["discussed"] == [] and [tuple(c) for c in told[1]["citations"]] == [("p", "p", "")] and not {3, 4, 5, 6} & set(told)
