"""Benchmark decontamination by winnowing (DataFrame functions only).

The hashes of all runs of ``k`` words of a text are winnowed: of every ``window - k + 1`` runs that follow each
other, the smallest hash stays. A window of ``window`` words holds exactly that many runs, so a text that holds a
window of a benchmark item also keeps that window's smallest hash: training texts and benchmark are joined on
these distinct fingerprints alone, about two for seven words at the usual sizes, and no shared span of
``window`` words or more is missed. An item of fewer words is one window of its own
length; its fingerprint is the hash of all its words, and texts give every run of the lengths that such items have.

Hits are extended: in texts with a hit, every window whose fingerprint is one of the benchmark's must agree with a window
of that fingerprint word for word. Windows of the same items form a class, and texts with the same classes share one
list of items, so a passage that many items and many texts hold is listed once.

Texts of documents are not shuffled, only those with a hit are, once for each digest. What documents are joined with
(fingerprints, windows, answers) has unique keys; it is broadcast up to ``BROADCAST`` rows, and beyond that
joined on a salted key, so no task gets all rows of a fingerprint that a third of all documents hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, read, staged

WINDOW = 10
RUN = 5
#: Rows of a table with unique keys that may be broadcast (at most about 150 bytes each).
BROADCAST = 200_000
SALTS = 16
#: What lies between words: all of ASCII but digits and lower-case letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A window's start and length in one number: start * PLACE + length.
PLACE = 256


def words_of(text: Column) -> Column:
    """Words of a text, A-Z in lower case; none for null."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lower, BETWEEN), "")


def from_zero(n: Column) -> Column:
    """0, 1, ..., n - 1; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def run_hashes(words: Column, length: int) -> Column:
    """The hash of each run of ``length`` words."""
    return F.transform(from_zero(F.size(words) - length + 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(length)]))


def smallest(hashes: Column, many: int) -> Column:
    """The smallest of each ``many`` hashes that follow each other."""
    return F.transform(from_zero(F.size(hashes) - many + 1), lambda j: F.least(*[F.get(hashes, j + i) for i in range(many)]) if many > 1 else F.get(hashes, j))


def with_fingerprints(texts: DataFrame, window: int, k: int, short: list[int]) -> tuple[DataFrame, dict[int, Column]]:
    """``texts`` (words) with the hashes that the columns need, and by length (0: winnowed) the fingerprint of the window at each place."""
    least = texts.withColumn("hashes", run_hashes(F.col("words"), k)).withColumn("least", smallest(F.col("hashes"), window - k + 1))

    def runs(length: int) -> Column:
        return F.transform(from_zero(F.size("words") - length + 1), lambda i: F.xxhash64(F.slice("words", i + 1, length)))

    return least, {0: F.col("least")} | {length: runs(length) for length in short}


def item_windows(benchmark: DataFrame, window: int, k: int) -> DataFrame:
    """(gram, length, hash, items, cls) of the distinct windows of items (item_id, text): ``cls`` stands for ``items``."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    long = words.where(F.size("words") >= window).withColumn("least", smallest(run_hashes(F.col("words"), k), window - k + 1))
    cut = F.transform("least", lambda h, i: F.struct(F.lit(0).alias("length"), F.array_join(F.slice("words", i + 1, window), " ").alias("gram"), h.alias("hash")))
    short = words.where(F.size("words") < window).select("item_id", F.size("words").alias("length"), F.array_join("words", " ").alias("gram"), F.xxhash64("words").alias("hash"))
    rows = long.select("item_id", F.explode(cut).alias("w")).select("item_id", "w.*").unionByName(short)
    whole = rows.groupBy("gram", "length", "hash").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return whole.withColumn("cls", F.unhex(F.sha2(F.array_join(F.transform("items", lambda i: i.cast("string")), ","), 256)))


def met(rows: DataFrame, table: DataFrame, keys: list[str], how: str, spread: list[str], wide: str | None = None) -> DataFrame:
    """``rows`` joined with a staged table of unique keys; beyond BROADCAST rows on keys salted by the columns ``spread`` of ``rows``.

    ``wide`` is an array column of ``table``, whose items count as rows.
    """
    if (table.agg(F.sum(1 + F.size(wide) if wide else F.lit(1))).first()[0] or 0) <= BROADCAST:
        return rows.join(F.broadcast(table), keys, how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], how).drop("salt")


def matches(texts: DataFrame, windows: DataFrame, window: int, k: int) -> DataFrame:
    """(digest, code, cls) of distinct texts (digest, text): the windows that occur, found by fingerprint and extended word for word."""
    short = sorted(r["length"] for r in windows.select("length").distinct().collect() if r["length"])
    known = staged(windows.select("length", "hash").distinct(), "leak-fingerprints")

    least, printed = with_fingerprints(texts.select("digest", words_of(F.col("text")).alias("words")), window, k, short)

    def distinct(n: int, prints: Column) -> Column:
        return F.transform(F.array_distinct(prints), lambda h: F.struct(F.lit(n).alias("length"), h.alias("hash")))

    asked = least.select("digest", F.explode(F.concat(*[distinct(n, p) for n, p in printed.items()])).alias("f")).select("digest", "f.*")
    hits = staged(met(asked, known, ["length", "hash"], "left_semi", ["digest"]).select("digest").distinct(), "leak-digests")

    whole = met(texts, hits, ["digest"], "left_semi", ["digest"]).groupBy("digest").agg(F.first("text").alias("text"))
    least, printed = with_fingerprints(whole.select("digest", words_of(F.col("text")).alias("words")), window, k, short)

    def grams(n: int, prints: Column) -> Column:
        words = n or window
        return F.transform(prints, lambda h, i: F.struct(F.lit(n).alias("length"), h.alias("hash"), (i * F.lit(PLACE).cast("long") + words).alias("code"), F.array_join(F.slice("words", i + 1, words), " ").alias("gram")))

    around = least.select("digest", F.explode(F.concat(*[grams(n, p) for n, p in printed.items()])).alias("w")).select("digest", "w.*")
    return met(around, staged(windows.select("length", "hash", "gram", "cls"), "leak-windows"), ["length", "hash", "gram"], "inner", ["digest", "code"]).select("digest", "code", "cls")


def prepared(docs: DataFrame, benchmark: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (doc_id, text, digest), the benchmark's windows and the windows that occur in each distinct text."""
    if not 1 <= k <= window < PLACE:
        raise ValueError(f"need 1 <= k <= window < {PLACE}")
    texts = pick(docs, "doc_id", "text").withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    windows = staged(item_windows(pick(benchmark, "item_id", "text"), window, k), "leak-items")
    return texts, windows, staged(matches(texts.select("digest", "text"), windows, window, k), "leak-found")


def classes_of(windows: DataFrame) -> DataFrame:
    return staged(windows.groupBy("cls").agg(F.first("items").alias("items")), "leak-classes")


def leaks(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, k: int = RUN) -> DataFrame:
    """(doc_id, start, length, items): one row per place of a document where a window of the benchmark occurs, counted in words.

    ``items`` are the ids of all items that have the window. Awkward rows are treated as in :func:`contamination`.
    """
    texts, windows, found = prepared(docs, benchmark, window, k)
    per_text = staged(found.groupBy("digest").agg(F.collect_list(F.struct("code", "cls")).alias("found")), "leak-places")
    rows = met(texts.select("doc_id", "digest"), per_text, ["digest"], "inner", ["doc_id"], "found").select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
    named = met(rows, classes_of(windows), ["cls"], "inner", ["doc_id", "code"], "items")
    return named.select("doc_id", F.floor(F.col("code") / PLACE).alias("start"), (F.col("code") % PLACE).cast("int").alias("length"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, k: int = RUN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    ``n_hit`` words lie inside a window of the benchmark (item_id, text); ``n_items`` items have such windows, and the digest
    is that of their ids, sorted as strings and joined by commas. Null and empty texts have no words, and items
    without words no windows. Windows of items with a null id hit words but are not listed; an id that repeats is
    listed once. Rows that repeat an id are documents of their own. An empty table of documents gives no rows, an
    empty benchmark no hits. Extra columns, whatever their names, are not read.
    """
    texts, windows, found = prepared(docs, benchmark, window, k)
    zero = F.lit(0).cast("long")

    def cover(so_far: Column, code: Column) -> Column:  # words covered and the end of the last window, by start
        start = F.floor(code / PLACE)
        end = start + code % PLACE
        return F.struct((so_far.n + F.greatest(zero, end - F.greatest(so_far.end, start))).alias("n"), F.greatest(so_far.end, end).alias("end"))

    covered = F.aggregate(F.array_sort("codes"), F.struct(zero.alias("n"), zero.alias("end")), cover).n
    hit = staged(found.groupBy("digest").agg(F.collect_set("code").alias("codes"), F.array_sort(F.collect_set("cls")).alias("classes")).select("digest", covered.alias("n_hit"), "classes"), "leak-texts")
    kinds = hit.select("classes").distinct().select("classes", F.explode("classes").alias("cls"))
    named = met(kinds, classes_of(windows), ["cls"], "inner", ["classes"], "items").groupBy("classes").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    listed = named.select("classes", F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").alias("ids"))
    lists = staged(listed.select("classes", "n_items", F.sha2(F.col("ids").cast("binary"), 256).alias("items_sha256")), "leak-lists")
    answers = staged(met(hit, lists, ["classes"], "inner", ["digest"], "classes").drop("classes"), "leak-answers")

    counted = texts.select("doc_id", "digest", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    return met(counted, answers, ["digest"], "left", ["doc_id"]).select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated")
    )


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram FROM b, range(1, greatest(len(w) - 9, 1) + 1) t(i) WHERE len(w) > 0),
grams AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM d, (SELECT DISTINCT n FROM windows), range(1, len(w) + 1) t(i) WHERE i + n - 1 <= len(w)),
hits AS (SELECT r, i, g.n, item_id FROM grams g JOIN windows USING (n, gram)),
words AS (SELECT r, count(DISTINCT place) AS n_hit FROM hits, range(i, i + n) t(place) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
