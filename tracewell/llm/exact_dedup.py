"""Exact deduplication over an extendible-hash index of written files (DataFrame functions only).

The index has one entry per distinct normalised text: its digest, the smallest doc_id, the group's
size and its place in the chain of entries that share the digest. Entries lie in buckets named by
the leading bits of the digest. A bucket that holds more than ``capacity`` entries is split by one
more bit, which doubles the directory, until it fits or the directory's depth is reached; what still
overflows stays in one bucket as a longer chain. The depth follows the number of entries, up to 20 bits, and
from there on the capacity does, so the directory, which maps each prefix of so many bits to its bucket, never
has more than 2**20 rows and may be broadcast. Index files are range-partitioned by bucket and key.

Documents are routed by the directory: each task owns buckets, gets their entries and the documents whose
prefixes the directory maps to them, and reads both in the order of keys.

Copies are folded before the shuffle (partial aggregation), so a group that holds a third of all
rows sends one row per map task. Grouping is by digest *and* text, which compares bytes; two texts
with one digest become two chained entries, and only their documents are matched by text.
Looking the documents up moves 40 bytes each; entries that hold over a thousandth of all rows (a
thousand at most, so their broadcast is bounded) are salted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, by_place, pick, place_of, read, staged

SALTS = 64
HOT_SHARE = 1000
#: Bits that the directory has at most.
MAX_DEPTH = 20


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def directory(entries: DataFrame, capacity: int, max_depth: int) -> DataFrame:
    """(prefix, bucket, depth): for each prefix of ``max_depth`` bits in use, the bucket that owns it.

    A bucket of local depth d holds the keys that share d bits. Depths are tried by doubling: the
    first depth at which the bucket fits is its depth.
    """
    leaves = entries.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"))
    tried = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(max_depth)))).withColumn(
        "bucket", F.expr(f"shiftright(prefix, {max_depth} - depth)")
    )
    fits = tried.groupBy("depth", "bucket").agg(F.sum("n").alias("held"))
    return (
        tried.join(fits, ["depth", "bucket"])
        .where((F.col("held") <= capacity) | (F.col("depth") == max_depth))
        .groupBy("prefix")
        .agg(F.min(F.struct("depth", "bucket")).alias("own"))
        .select("prefix", "own.bucket", "own.depth")
    )


def depth_of(entries: int, capacity: int) -> int:
    """Bits of the directory for so many entries: room for three splits beyond an even spread, 20 at most."""
    return min(MAX_DEPTH, max(0, (entries // max(1, capacity)).bit_length() + 3))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 128, key_hex: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket.

    Texts are equal when identical after each run of white space is one space; null counts as empty.
    The smallest doc_id of a group stays. Null ids sort last: a group of only null ids has a null
    keep_id and keeps its rows. Rows that repeat both id and text are one document and share its
    decision. An empty table gives no rows. Extra columns, whatever their names, are not read. ``key_hex`` is how
    many hex digits of the digest are the index key (fewer only to test chains).
    """
    texts = pick(docs, doc_id=id_col, text=text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    keyed = texts.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)).withColumn("key", F.unhex(F.substring("sha", 1, key_hex)))

    distinct = keyed.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    chain = W.partitionBy("key")
    entries = staged(distinct.select("key", "keep_id", "group_size").withColumn("chained", F.count(F.lit(1)).over(chain)), "dedup-entries")
    sums = entries.agg(F.count(F.lit(1)), F.sum("group_size")).first()
    rows = sums[1] or 0
    depth = depth_of(sums[0], capacity)
    prefix = F.shiftright(F.conv(F.substring(F.rpad(F.hex("key"), 5, "0"), 1, 5), 16, 10).cast("int"), MAX_DEPTH - depth).alias("prefix")
    entries = entries.withColumn("prefix", prefix)
    owners = staged(directory(entries, max(capacity, 4 * sums[0] >> depth), depth), "dedup-directory").select("prefix", "bucket", "depth")
    index = staged(entries.join(F.broadcast(owners), "prefix").repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "dedup-index")

    index = index.withColumn("hot", F.col("group_size") * HOT_SHARE > rows)
    single = index.where("chained = 1")
    hot = single.where("hot").select("key", F.lit(True).alias("is_hot"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    held = single.select("key", "bucket", "depth", F.explode(salts).alias("salt"), F.lit(True).alias("is_entry"), F.struct("keep_id", "group_size").alias("entry"))
    chains = index.where("chained > 1").select("key").distinct()
    collide = not chains.isEmpty()
    asked = keyed.join(chains, "key", "left_anti") if collide else keyed
    routed = (
        asked.select("doc_id", "key", "sha", prefix)
        .join(F.broadcast(owners), "prefix")
        .join(F.broadcast(hot), "key", "left")
        .withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
        .select("key", "bucket", "depth", "salt", F.lit(False).alias("is_entry"), "doc_id", "sha")
    )
    # a bucket is named by its number and depth; the entry of a key comes before the documents that ask for it
    owner = W.partitionBy("bucket", "depth", "salt", "key").orderBy(F.desc("is_entry")).rowsBetween(W.unboundedPreceding, 0)
    stacked = routed.unionByName(held, allowMissingColumns=True).repartition("bucket", "depth", "salt")
    answered = stacked.withColumn("entry", F.first("entry", ignorenulls=True).over(owner)).where("NOT is_entry")
    wanted = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"), "bucket"]
    found = answered.select("doc_id", "sha", "bucket", "entry.keep_id", "entry.group_size").select(*wanted)

    if collide:  # two texts share a key: their documents are matched by their bytes
        members = keyed.join(index.where("chained > 1").select("key", "bucket").distinct(), "key")
        whole = members.groupBy("key", "norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found = found.unionByName(members.join(whole, ["key", "norm"]).select(*wanted))
    return found


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the pipeline's form of the operator.

    A row is found again by its id and the digest of its whole text; of rows that repeat both, one stays,
    and of a group of null ids only, one too. An empty table gives no rows. Extra columns of any name stay.
    Texts move once: rows are found again and repeats dropped in one partitioning.
    """
    def keyed(doc_id, sha):
        return {"key_null": doc_id.isNull(), "key_id": F.coalesce(doc_id.cast("string"), F.lit("")), "key_sha": sha}

    keys = ["key_null", "key_id", "key_sha"]
    kept = exact_dedup(docs).where("kept").select(*[c.alias(n) for n, c in keyed(F.col("doc_id"), F.col("text_sha256")).items()]).distinct()
    rows = by_place(docs).withColumns(keyed(F.col(place_of(docs, "doc_id")), F.sha2(normalised(F.col(place_of(docs, "text"))).cast("binary"), 256)))
    return rows.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys).toDF(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
