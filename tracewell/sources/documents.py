"""Structured documents (TEI XML) as a stream of events in reading order, each with the path of sections around it.

A document is one file and is parsed by one task as a stream: elements that have been told are dropped, so memory follows the longest
element, not the document. Files are read by Spark (any file system it reads). Views over the events are sections of any depth,
tables, figures, formulas, and every citation with its offset.
"""

from __future__ import annotations

import io
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prose

EVENT = (
    "paper string, at int, kind string, level int, path array<int>, headings array<string>, text string, label string, target string, offset int, inside int, cells array<array<string>>"
)
_KIND = pa.schema([
    ("paper", pa.string()), ("at", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("path", pa.list_(pa.int32())), ("headings", pa.list_(pa.string())), ("text", pa.string()), ("label", pa.string()),
    ("target", pa.string()), ("offset", pa.int32()), ("inside", pa.int32()), ("cells", pa.list_(pa.list_(pa.string()))),
])


def tag_of(element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def told(element) -> str:
    """All text of an element, white space as one blank."""
    return " ".join("".join(element.itertext()).split())


def child(element, name: str):
    return next((c for c in element if tag_of(c) == name), None)


def identity(element) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rsplit("}", 1)[-1] == "id"), None)


def paragraph(element) -> tuple[str, list[tuple[int, str, str | None, str | None]]]:
    """The text of a paragraph, and (offset, marker, target, type) of the references in it; white space as one blank, none at its ends."""
    out, refs = "", []

    def add(text: str | None) -> None:
        nonlocal out
        for i, word in enumerate((text or "").split(" ")):
            words = word.split()
            if (i or (word and word[:1].isspace())) and out and not out.endswith(" "):
                out += " "
            if words:
                out += " ".join(words)
                if word[-1:].isspace():
                    out += " "

    def walk(e) -> None:
        add(e.text)
        for c in e:
            if tag_of(c) == "ref":
                at = len(out)
                marker = told(c)
                add("".join(c.itertext()))
                if marker:
                    refs.append((at, marker, c.get("target"), c.get("type")))
            elif isinstance(c.tag, str):
                walk(c)
            add(c.tail)

    walk(element)
    return out.rstrip(), refs


def events_of(paper: str, content: bytes) -> list[tuple]:
    """The events of a document; a broken one ends with an event of kind error, after what could be read."""
    out: list[tuple] = []
    path: list[int] = []  # places of the open sections in their parents
    inner: list[int] = [0]  # sections seen so far in each of them
    headings: list[str | None] = []
    sections: list[int] = []  # the event of each
    whole: list[str] = []  # elements that are told as one

    def add(kind: str, text=None, label=None, target=None, offset=None, inside=None, cells=None) -> int:
        out.append((paper, len(out), kind, len(path), list(path), [h or "" for h in headings], text, label, target, offset, inside, cells))
        return len(out) - 1

    try:
        for event, e in ElementTree.iterparse(io.BytesIO(content), events=("start", "end")):
            tag = tag_of(e)
            if event == "start":
                if tag == "div" and not whole:
                    path.append(inner[-1])
                    inner[-1] += 1
                    inner.append(0)
                    headings.append(None)
                    sections.append(add("section"))
                elif tag in ("p", "figure", "formula", "head"):
                    whole.append(tag)
                continue
            if tag in ("p", "figure", "formula", "head") and whole:
                whole.pop()
                if whole:
                    continue  # part of what is told as a whole
                if tag == "head" and headings:
                    if headings[-1] is None:
                        headings[-1] = told(e)
                        at = sections[-1]
                        out[at] = (*out[at][:5], [h or "" for h in headings], headings[-1], e.get("n"), *out[at][8:])
                elif tag == "p":
                    text, refs = paragraph(e)
                    if text:
                        at = add("paragraph", text)
                        for offset, marker, target, kind in refs:
                            add("citation" if kind in (None, "bibr") else f"{kind} reference", marker, target=target, offset=offset, inside=at)
                elif tag == "formula":
                    label = child(e, "label")
                    number = told(label) if label is not None else None
                    if label is not None:
                        e.remove(label)
                    add("formula", told(e), number or identity(e))
                elif tag == "figure":
                    described, head, label = (child(e, n) for n in ("figDesc", "head", "label"))
                    caption = (told(described) if described is not None else "") or (told(head) if head is not None else "")
                    rows = [[told(c) for c in r if tag_of(c) == "cell"] for r in e.iter() if tag_of(r) == "row"]
                    is_table = e.get("type") == "table" or bool(rows)
                    add("table" if is_table else "figure", caption, (told(label) if label is not None else None) or identity(e), cells=rows if is_table else None)
                e.clear()
            elif tag == "div" and not whole and path:
                for held in (path, inner, headings, sections):
                    held.pop()
                e.clear()
    except ElementTree.ParseError as broken:
        add("error", str(broken))
    return out


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of every document at ``path``: sections, paragraphs, citations, tables, figures, formulas, errors, in reading order by ``at``.

    ``path`` of an event are the places of its sections in their parents, ``headings`` their headings, empty where a section has none. A
    citation names the paragraph that it is ``inside`` and its ``offset`` in that text.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(?:\.tei)?\.xml$", 1).alias("paper"), "content").where("paper <> ''")

    def read(batches):
        for batch in batches:
            for paper, content in zip(batch.column("paper").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = events_of(paper, content)
                for at in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096], strict=True), _KIND.types, strict=True)], schema=_KIND)

    return files.mapInArrow(read, EVENT)


def sections(events: DataFrame) -> DataFrame:
    """(paper, at, level, path, heading, parents, section_type): sections of any depth, with the headings above theirs."""
    rows = events.where("kind = 'section'")
    return rows.select("paper", "at", "level", "path", F.coalesce("text", F.lit("")).alias("heading"), F.slice("headings", F.lit(1), F.size("headings") - 1).alias("parents"), prose.section_type(F.coalesce("text", F.lit(""))).alias("section_type"))


def located_tables(events: DataFrame, results: tuple[str, ...], ablations: tuple[str, ...]) -> DataFrame:
    """(paper, at, section, headings, caption, rows, is_results, is_ablation): tables with the nearest heading above them, however deep they stand.

    A table shows results or an ablation if a heading around it or its caption has one of the words, their endings left out; for an ablation its first row counts too.
    """
    rows = events.where("kind = 'table'")
    named = F.filter("headings", lambda h: h != "")
    told_by = F.array_join(named, " ")
    first = F.array_join(F.get(F.col("cells"), F.lit(0)), " ")
    return rows.select(
        "paper", "at", F.element_at(F.concat(F.array(F.lit("")), named), -1).alias("section"), "headings", F.col("text").alias("caption"), F.col("cells").alias("rows"),
        prose.ablation(F.col("text"), told_by, F.lit(""), results).alias("is_results"), prose.ablation(F.col("text"), told_by, first, ablations).alias("is_ablation"),
    )


def formulas(events: DataFrame) -> DataFrame:
    return events.where("kind = 'formula' AND text <> ''").select("paper", "at", "label", F.col("text").alias("formula"), "headings")


def figures(events: DataFrame) -> DataFrame:
    return events.where("kind = 'figure'").select("paper", "at", "label", F.col("text").alias("caption"), "headings")


def cited_places(events: DataFrame) -> DataFrame:
    """(paper, at, entry, marker, offset, paragraph, context): every citation with its paragraph and offset; ``entry`` without its sign."""
    texts = events.where("kind = 'paragraph'").select("paper", F.col("at").alias("inside"), F.col("text").alias("paragraph"))
    rows = events.where("kind = 'citation'").select("paper", "at", F.regexp_replace("target", "^#", "").alias("entry"), F.col("text").alias("marker"), "offset", "inside").join(texts, ["paper", "inside"])
    begin = F.greatest(F.lit(0), F.col("offset") - 200)
    return rows.withColumn("context", F.substring(F.col("paragraph"), begin + 1, F.col("offset") - begin + F.length("marker") + 200)).drop("inside")
