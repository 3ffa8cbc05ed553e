"""File sources and guarded sinks: CSV, node-link JSON, XML tables, pages; writes that refuse to lose data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import prose
from ..operators.kg import folded

GRAPH = (
    "nodes array<struct<id: string, type: string, label: string, paper_id: string>>, links array<struct<source: string, target: string, type: string, weight: double>>, "
    "edges array<struct<source: string, target: string, type: string, weight: double>>"
)


def read_methods(spark: SparkSession, path: str) -> DataFrame:
    """A methods table: header-driven, every column a string, missing cells empty; quoted cells may span lines."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').na.fill("")


def read_graph(spark: SparkSession, path: str, fallback: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of node-link JSON documents; edges may be named edges or links. Dangling edges go.

    Where nothing is at ``path`` the artifact at ``fallback`` is read.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fallback and not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        path = fallback
    docs = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes = docs.select(F.explode("nodes").alias("n")).select("n.*")
    edges = docs.select(F.explode(F.coalesce("edges", "links")).alias("e")).select("e.*")
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def read_tables(spark: SparkSession, path: str, row_tag: str = "figure") -> DataFrame:
    """Table figures of XML documents: caption and rows of cells."""
    schema = "_type string, head string, figDesc string, table struct<row: array<struct<cell: array<string>>>>"
    found = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).where("_type = 'table'")
    return found.select(F.coalesce("figDesc", "head").alias("caption"), F.transform("table.row", lambda r: r["cell"]).alias("rows"))


def read_sections(spark: SparkSession, path: str, results: tuple[str, ...], ablations: tuple[str, ...]) -> DataFrame:
    """(paper, section, caption, rows, is_results, is_ablation): tables with the heading of the section around them.

    A section shows results or an ablation if its heading, or the table's caption, has one of the words, their endings left out.
    """
    figure = "array<struct<_type: string, head: string, figDesc: string, table: struct<row: array<struct<cell: array<string>>>>>>"
    found = spark.read.format("xml").option("rowTag", "div").schema(f"head string, figure {figure}").load(path)
    rows = found.select(F.regexp_extract(F.input_file_name(), "([^/]+?)(?:\\.tei)?\\.xml$", 1).alias("paper"), F.col("head").alias("section"), F.explode("figure").alias("f")).where("f._type = 'table'")
    rows = rows.select("paper", "section", F.coalesce("f.figDesc", "f.head").alias("caption"), F.transform("f.table.row", lambda r: r["cell"]).alias("rows"))
    header = F.array_join(F.get(F.col("rows"), F.lit(0)), " ")
    return rows.withColumn("is_results", prose.ablation(F.col("caption"), F.col("section"), F.lit(""), results)).withColumn("is_ablation", prose.ablation(F.col("caption"), F.col("section"), header, ablations))


def read_authors(spark: SparkSession, path: str, row_tag: str = "author", most: int = 30) -> DataFrame:
    """(paper, place, name, affiliation, institution) of the authors in document headers.

    One row per name, accents and case apart; names under 3 or over 60 characters, without letters or with over 15 digits in a
    hundred characters are no names; ``most`` a paper, which is the feature.
    """
    schema = "persName struct<forename: array<string>, surname: string>, affiliation array<struct<orgName: array<struct<_VALUE: string, _type: string>>>>"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    orgs = F.coalesce(F.get(F.col("affiliation"), F.lit(0))["orgName"], F.array().cast("array<struct<_VALUE: string, _type: string>>"))
    named = rows.select(
        F.regexp_extract(F.input_file_name(), "([^/]+?)(?:\\.tei)?\\.xml$", 1).alias("paper"), F.monotonically_increasing_id().alias("at"), F.trim(F.concat_ws(" ", F.array_join("persName.forename", " "), "persName.surname")).alias("name"),
        F.array_join(F.transform(orgs, lambda o: o["_VALUE"]), ", ").alias("affiliation"), F.coalesce(F.get(F.filter(orgs, lambda o: o["_type"] == "institution"), F.lit(0))["_VALUE"], F.get(orgs, F.lit(0))["_VALUE"]).alias("institution"),
    )
    digits = F.length(F.regexp_replace("name", "[^0-9]", "")) / F.length("name")
    good = named.where(F.length("name").between(3, 60) & F.col("name").rlike("[A-Za-z]") & (digits <= 0.15)).withColumn("key", folded(F.col("name")))
    first = good.groupBy("paper", "key").agg(F.min(F.struct("at", "name", "affiliation", "institution")).alias("a"))
    ranked = first.withColumn("place", F.row_number().over(W.partitionBy("paper").orderBy("a.at"))).where(F.col("place") <= most)
    return ranked.select("paper", "place", "a.name", "a.affiliation", "a.institution")


def read_bibliography(spark: SparkSession, path: str, row_tag: str = "biblStruct") -> DataFrame:
    """(paper, entry, title, year, authors, doi, arxiv, venue) of reference lists; a year is the first of 1900 to 2099 in a date."""
    person = "persName: struct<forename: array<string>, surname: string>"
    titles = "title: array<struct<_VALUE: string, _level: string, _type: string>>"
    schema = f"`_xml:id` string, analytic struct<{titles}, author: array<struct<{person}>>>, monogr struct<{titles}, author: array<struct<{person}>>, imprint: struct<date: array<struct<_VALUE: string, _when: string>>>>, idno array<struct<_VALUE: string, _type: string>>"
    rows = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).withColumnRenamed("_xml:id", "entry").where("entry IS NOT NULL")
    every = F.concat(F.coalesce("analytic.title", F.array().cast("array<struct<_VALUE: string, _level: string, _type: string>>")), F.coalesce("monogr.title", F.array().cast("array<struct<_VALUE: string, _level: string, _type: string>>")))
    date = F.get(F.col("monogr.imprint.date"), F.lit(0))
    authors = F.filter(F.coalesce("analytic.author", "monogr.author"), lambda a: a["persName"]["surname"].isNotNull())
    named = lambda kind: F.get(F.filter("idno", lambda i: F.lower(i["_type"]).startswith(kind)), F.lit(0))["_VALUE"]
    return rows.select(
        F.regexp_extract(F.input_file_name(), "([^/]+?)(?:\\.tei)?\\.xml$", 1).alias("paper"), "entry",
        F.coalesce(F.get(F.filter(every, lambda t: t["_type"] == "main"), F.lit(0))["_VALUE"], F.get(every, F.lit(0))["_VALUE"]).alias("title"),
        F.nullif(F.regexp_extract(F.coalesce(date["_when"], date["_VALUE"], F.lit("")), r"((?:19|20)\d{2})", 1), F.lit("")).alias("year"),
        F.transform(authors, lambda a: F.concat(a["persName"]["surname"], F.lit(", "), F.coalesce(F.concat(F.substring(F.get(a["persName"]["forename"], F.lit(0)), 1, 1), F.lit(".")), F.lit("")))).alias("authors"),
        named("doi").alias("doi"), named("arxiv").alias("arxiv"), F.get(F.filter(every, lambda t: t["_level"].isin("j", "m")), F.lit(0))["_VALUE"].alias("venue"),
    )


def read_rows(spark: SparkSession, path: str, wanted: tuple[str, ...] = ("name", "citation", "links")) -> DataFrame:
    """The wanted columns of a CSV file, found without regard to case; missing ones empty, rows without the first one left out."""
    rows = read_methods(spark, path)
    places = {c.strip().lower(): i for i, c in enumerate(rows.columns)}
    plain = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    return plain.select(*[(F.col(f"c{places[w]}") if w in places else F.lit("")).alias(w) for w in wanted]).where(F.trim(wanted[0]) != "")


def export_artifacts(artifacts: dict[str, DataFrame], path: str, force: bool = False) -> dict[str, bool]:
    """Each table under its name in the folder, by a guarded write; which ones were written."""
    return {name: guarded_write(df, f"{path.rstrip('/')}/{name}", force=force) for name, df in artifacts.items()}


def graph_artifacts(nodes: DataFrame, edges: DataFrame, macro: tuple[str, ...]) -> dict[str, DataFrame]:
    """The tables of a graph that pages read: all nodes and edges, those of the ``macro`` node types with degrees, and counts by type."""
    kept = nodes.where(F.col("type").isin(*macro))
    ends = kept.select("id")
    among = edges.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi").dropDuplicates(["src", "dst", "type"])
    both = among.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(among.select("dst", "src"))
    degree = both.groupBy("id").agg(F.countDistinct("other").alias("degree"))
    return {"nodes": nodes, "edges": edges, "macro_nodes": kept.join(degree, "id", "left").fillna({"degree": 0}), "macro_edges": among, "landing": nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))}


def page_structure(pages: DataFrame) -> DataFrame:
    """Title, first heading, host and number of links and paragraphs of raw pages."""
    return pages.select(
        "page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit("<a ")).alias("n_links"), F.regexp_count("html", F.lit("<p>")).alias("n_paragraphs"),
    )


def guarded_write(df: DataFrame, path: str, key: str | None = None, present: DataFrame | None = None, force: bool = False) -> bool:
    """Replace the table at ``path`` unless that would lose data; returns whether it was written.

    An empty table never replaces one with rows. With ``key``, neither does one that lacks keys of
    the old table that are still ``present`` (all, if not given) or that has fewer rows. What is
    written goes to a side folder first; the old table is moved aside, the new one into its place, and only then the
    old one removed, so that at each moment one whole table is there.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    side = jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    df.write.mode("overwrite").parquet(f"{path}.new")
    new = spark.read.parquet(f"{path}.new")
    ok = True
    if fs.exists(at) and not force:
        old = spark.read.parquet(path)
        n_old, n_new = old.count(), new.count()
        ok = n_new > 0 or n_old == 0
        if ok and key:
            dropped = old.select(key).distinct().join(new.select(key), key, "left_anti")
            dropped = dropped if present is None else dropped.join(present.select(key), key, "left_semi")
            ok = n_new >= n_old and dropped.isEmpty()
    if not ok:
        fs.delete(side, True)
        return False
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old")
    fs.delete(aside, True)
    had = fs.exists(at)
    if had and not fs.rename(at, aside):
        raise OSError(f"{path} could not be moved aside; the new table is at {path}.new")
    if not fs.rename(side, at):
        if had:
            fs.rename(aside, at)
        raise OSError(f"{path}.new could not be moved to {path}")
    fs.delete(aside, True)
    return True
