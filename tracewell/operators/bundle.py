"""What a knowledge graph says about the papers of an answer: sections by intent, capped, within a budget of words.

All questions are answered at once. The edges of papers are met once, whatever asks for them, and a paper's lines are ranked and capped before they meet
lists of papers, so a paper with very many edges sends its first lines only. Sections are put together for each list of papers, which questions share; a question
then picks the sections that its intent and words ask for.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import staged

PAPERS = 5
# Titles of sections, in their order, with the most lines that each shows.
SECTIONS = (
    ("Key Contributions", 6), ("Cross-Method Comparisons", 5), ("Known Limitations", 10), ("Shared Techniques (among relevant methods)", 5), ("Hardware Used", 5), ("Citation Network", 8),
    ("Citation Stance (builds-on vs differs-from)", 6), ("Authors (from TEI headers)", 6), ("Institutions Involved", 5), ("Foundational Works Shared Across Top Methods", 5),
    ("Datasets (ground truth, from method metadata)", 5), ("Inferred Relationships (from graph structure)", 5),
)
# Words of a question that ask for hardware and for people, and what makes a comparison specific.
HARDWARE = ("hardware", "robot", "gripper", "sensor", "camera", "arm", "franka", "allegro", "realsense")
PEOPLE = ("author", "wrote", "researcher", "lab", "university", "institution", "who")
SPECIFIC = r"[0-9]+\.?[0-9]*\s*%|[0-9]+\.[0-9]+|[A-Z][a-z]+(?:Net|GAN|GPD|Grasp|VGN|SAM|GPT|Former)"


def says(words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, [F.contains(F.lower("query"), F.lit(w)) for w in words])


def line(*parts: Column | str) -> Column:
    """Parts as text, null as empty."""
    return F.concat(F.lit("- "), *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]).alias("line")


def first_of(rows: DataFrame, most: int, *key: str) -> DataFrame:
    at = F.row_number().over(W.partitionBy(*key).orderBy("k1", "k2", "k3", "line"))
    return rows.withColumn("at", at).where(F.col("at") <= most)


def lead(rows: DataFrame, text: Column, most: int, distinct: bool = False) -> DataFrame:
    """(paper, name, line, k2, k3, at): the first lines of each paper, or the first different ones."""
    told = rows.select("paper", "name", text, F.col("way").cast("long").alias("k2"), F.col("seq").cast("long").alias("k3"))
    if distinct:
        told = told.groupBy("paper", "name", "line").agg(F.min(F.struct("k2", "k3")).alias("k")).select("paper", "name", "line", "k.*")
    at = F.row_number().over(W.partitionBy("paper", "name").orderBy("k2", "k3", "line"))
    return told.withColumn("at", at).where(F.col("at") <= most)


def rows_of(top: DataFrame, led: DataFrame, *, papers: int = PAPERS, each: int | None = None) -> DataFrame:
    """(list, line, k1, k2, k3): the lines that each list's papers lead to, papers in their order, at most ``each`` of a paper."""
    rows = top.where(F.col("place") <= papers).join(led.drop("at"), ["paper", "name"]).select("list", "paper", "line", F.col("place").cast("double").alias("k1"), "k2", "k3")
    return (first_of(rows, each, "list", "paper") if each else rows).select("list", "line", "k1", "k2", "k3")


def counted(top: DataFrame, rows: DataFrame, text: Column, *key: str) -> DataFrame:
    """(list, key, line, n, k1, k2, k3): a line per value of ``key``, those of most papers first, then first seen."""
    told = top.join(rows.groupBy("paper", "name", *key).agg(F.min("seq").alias("seq")), ["paper", "name"])
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]), ", ")
    sums = told.groupBy("list", *key).agg(F.count(F.lit(1)).alias("n"), names.alias("names"), F.min(F.struct("place", "seq")).alias("seen"))
    return sums.select("list", *key, text, "n", (-F.col("n")).cast("double").alias("k1"), F.col("seen.place").cast("long").alias("k2"), F.col("seen.seq").cast("long").alias("k3"))


def once(rows: DataFrame) -> DataFrame:
    return rows.groupBy("list", "line").agg(F.min(F.struct("k1", "k2", "k3")).alias("k")).select("list", "line", "k.*")


def in_order(lines: DataFrame, *key: str) -> DataFrame:
    """(key, lines): lines by their places."""
    return lines.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]).alias("lines"))


def placed(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, list, papers): the first papers of each question that the graph has, with their names and places; equal lists have one name."""
    known = ranked.join(nodes.where("type = 'paper'").select(F.col("id").alias("paper"), F.coalesce("label", F.lit("")).alias("name")), "paper").groupBy("query_id", "paper", "name").agg(F.min("place").alias("place"))
    at = F.row_number().over(W.partitionBy("query_id").orderBy("place", "paper"))
    rows = known.withColumn("place", at).where(F.col("place") <= PAPERS)
    papers = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "paper", "name"))).alias("papers"))
    return staged(papers.select("query_id", F.sha2(F.to_json("papers"), 256).alias("list"), "papers"))


def context_bundles(questions: DataFrame, ranked: DataFrame, nodes: DataFrame, edges: DataFrame, predicted: DataFrame, words: int = 500) -> DataFrame:
    """(query_id, context, n_words, n_sections): the text that a model is given with each question; a question of which nothing is known has the empty text.

    ``questions`` has query_id (unique), query and intent (BROAD, TECHNICAL, EVALUATION, COMPARISON, LIMITATION or PEOPLE), ``ranked`` query_id, paper and place, ``nodes`` id, type, label,
    subtype, confidence, is_methodology and year, ``edges`` src, dst (one edge for each pair), type, seq (their order), mentions and sentiment,
    ``predicted`` paper, type, label, confidence, relevance and seq. Null texts count as empty.
    """
    asked = placed(ranked, nodes)
    top = staged(asked.groupBy("list").agg(F.first("papers").alias("papers")).select("list", F.explode("papers").alias("p")).select("list", "p.*"))
    papers = staged(top.select("paper", "name").distinct())
    edges = staged(edges.select("src", "dst", "type", "seq", "mentions", "sentiment"))
    ends = nodes.select(F.col("id").alias("other"), F.col("type").alias("kind"), "label", "subtype", "confidence", "is_methodology", "year")
    met = staged(edges.withColumnRenamed("dst", "other").join(papers.withColumnRenamed("paper", "src"), "src").withColumnRenamed("src", "paper").withColumn("way", F.lit(0)).join(ends, "other"))
    back = edges.where("type = 'cites'").withColumnRenamed("src", "other").join(papers.withColumnRenamed("paper", "dst"), "dst").withColumnRenamed("dst", "paper").join(ends, "other").withColumn("way", F.lit(1))

    name, label, mentions, most = F.col("name"), F.col("label"), F.coalesce("mentions", F.lit(0)), [n for _, n in SECTIONS]
    cites = met.where("type = 'cites'")
    authors = met.where(F.col("kind") == "author")
    shown = in_order(lead(authors, F.coalesce("label", F.lit("")).alias("line"), 5), "paper", "name").withColumn("few", F.array_join("lines", ", "))
    people = authors.groupBy("paper", "name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq"), F.min("way").alias("way")).join(shown, ["paper", "name"])
    methods = edges.join(nodes.where("type = 'method'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("method"), F.col("dst").alias("paper"))
    sets = edges.where("type in ('evaluated_on', 'uses_dataset')").select(F.col("src").alias("method"), F.col("dst").alias("other")).join(ends.where("kind = 'dataset'").select("other", "label"), "other")
    used = papers.join(methods, "paper").join(sets, "method").select("paper", "name", "label").distinct().withColumns({"way": F.lit(0), "seq": F.lit(0)})
    data = in_order(lead(used, F.coalesce("label", F.lit("")).alias("line"), 5), "paper", "name").select("paper", "name", F.array_join("lines", ", ").alias("few"), F.lit(0).alias("way"), F.lit(0).alias("seq"))
    guessed = predicted.where("type <> 'outperforms' and relevance >= 0.35").join(papers, "paper").withColumn("way", F.lit(0))

    def percent(c: str) -> Column:
        return F.concat(F.format_string("%.0f", F.rint(F.col(c) * 100)), F.lit("%"))

    telling = F.coalesce(label, F.lit("")) != ""
    techniques = staged(counted(top, met.where(telling & (F.col("kind") == "technique")), line(label, " (", F.col("subtype"), "): used by ", F.col("names")), "other", "label", "subtype"))
    external = counted(top, met.where(telling & (F.col("type") == "cites_external")), line("[", F.col("n"), " papers] ", F.substring("label", 1, 120), F.concat(F.lit(" ("), F.col("year"), F.lit(")"))), "label", "year")
    sections = (
        rows_of(top, lead(met.where((F.col("kind") == "contribution") & ~F.coalesce("is_methodology", F.lit(False)) & (F.col("confidence") == "high") & (F.length("label") > 30)), line(name, ": ", label), 2), papers=3, each=2),
        rows_of(top, lead(met.where((F.col("kind") == "comparison") & (F.coalesce("confidence", F.lit("")) != "low") & F.col("label").rlike(SPECIFIC)), line(name, ": ", label), most[1]), papers=3),
        rows_of(top, lead(met.where(F.col("kind") == "limitation"), line(name, ": ", label), 2), each=2),
        techniques.where("n >= 2"),
        rows_of(top, lead(met.where(F.col("kind") == "hardware"), line(name, ": ", label), most[4])),
        # as many different lines of a paper as the section shows: each of them that an earlier paper has said already fills a place there
        once(rows_of(top, lead(cites, line(name, " cites ", label, " (", mentions, " mentions)"), most[5], True)).unionByName(rows_of(top, lead(back, line(label, " cites ", name, " (", mentions, " mentions)"), most[5], True)))),
        once(rows_of(top, lead(cites.where((F.col("sentiment") != "neutral") & (F.col("sentiment") != "")), line(name, " ", F.translate("sentiment", "_", " "), " ", label), most[6], True), papers=4)),
        rows_of(top, lead(people, line(name, ": ", F.col("few"), F.when(F.col("n") > 5, F.concat(F.lit(" +"), F.col("n") - 5))), 1)),
        counted(top, met.where(F.col("kind") == "institution"), line(label, " (", F.col("n"), " papers)"), "label"),
        external.where("n >= 2"),
        rows_of(top, lead(data, line(name, ": ", F.col("few")), 1)),
        rows_of(top, lead(guessed, line(name, " likely ", F.translate("type", "_", " "), ": ", label, " (", percent("confidence"), " graph confidence, ", percent("relevance"), " semantic match)"), most[11])),
    )
    capped = [first_of(rows, n, "list").select("list", F.lit(i).alias("section"), "at", "line") for i, (n, rows) in enumerate(zip(most, sections, strict=True))]
    told = in_order(reduce(DataFrame.unionByName, capped), "list", "section")
    bundles = told.groupBy("list").agg(F.map_from_entries(F.collect_list(F.struct("section", "lines"))).alias("told"))

    # a technique that one paper uses is shown if the question names it and those of more papers leave room
    full = techniques.groupBy("list").agg(F.count_if(F.col("n") >= 2).alias("shared")).where(F.col("shared") < most[3])
    single = techniques.where("n < 2").join(full, "list")
    named = questions.select("query_id", F.lower("query").alias("query")).join(asked.select("query_id", "list"), "query_id").join(single, "list").where(F.contains("query", F.lower("label")))
    named = in_order(first_of(named, most[3], "query_id").where(F.col("at") + F.col("shared") <= most[3]), "query_id").withColumnRenamed("lines", "named")

    def meant(*intents: str) -> Column:
        return F.col("intent").isin(*intents)

    always, who = F.lit(True), meant("PEOPLE") | says(PEOPLE)
    wanted = (
        meant("BROAD", "TECHNICAL"), meant("EVALUATION", "COMPARISON"), meant("LIMITATION"), always, says(HARDWARE), always, meant("COMPARISON", "BROAD"), who, who, meant("BROAD", "COMPARISON"),
        meant("EVALUATION", "TECHNICAL", "BROAD"), always,
    )
    none = F.array().cast("array<string>")

    def text(i: int) -> Column:
        lines = F.coalesce(F.col("told")[i], none)
        lines = F.concat(lines, F.coalesce("named", none)) if i == 3 else lines
        return F.when(wanted[i] & (F.size(lines) > 0), F.concat(F.lit(f"{SECTIONS[i][0]}:\n"), F.array_join(lines, "\n")))

    whole = questions.join(asked.select("query_id", "list"), "query_id", "left").join(bundles, "list", "left").join(named, "query_id", "left")
    found = whole.select("query_id", F.array_compact(F.array(*[text(i) for i in range(len(SECTIONS))])).alias("texts")).select("query_id", F.array_join("texts", "\n\n").alias("text"), F.size("texts").alias("n_sections"))
    split = found.withColumn("words", F.regexp_extract_all("text", F.lit(r"(\S+)"), 1))
    cut = F.when(F.size("words") > words, F.array_join(F.slice("words", 1, words), " ")).otherwise(F.col("text"))
    return split.select("query_id", cut.alias("context"), F.least(F.size("words"), F.lit(words)).alias("n_words"), "n_sections")
