"""Exact Jaccard self-join of documents on word shingles, with set-relation skipping.

Sets are ordered by one global order of shingles (frequent ones last, then by hash), so two sets
that reach the threshold share a shingle among the first ``n - ceil(0.8 n) + 1`` of each: the prefix.
Prefix shingles are the index; an index list is kept in blocks by set size, and entries carry
their position. Two relations between sets save work:

* Index lists: a list is kept in blocks by set size and position. What a block's smallest and largest
  size, position and rest leave room for decides which pairs of blocks can hold a link; all other blocks are
  skipped unread, and the rest are met by an equi-join on the block. Among their entries, one at positions (i, j)
  is skipped when min(i, j) + min(n - i, m - j) falls short of the overlap needed. Summed over lists,
  common prefix shingles and last positions bound a pair's overlap again before any set is fetched.
* Answers: the answer to a set is its component, and equal sets are one class. Classes made up mostly of frequent shingles (groups of near
  copies) are first compared in blocks that share a min-hash of their frequent shingles. A set's
  answers then extend to the component found so far: in an index list only sets outside the list's
  largest component ask, and only sets of other components answer. So a group of n near copies costs
  its blocks, not n * n pairs, and no link between components is lost: every pair of sets that share
  a prefix shingle is in one component, was compared in one block, or is a candidate.

Nothing here is capped: what is frequent (a broadcast of at most ``FREQUENT`` shingles) only
decides the order and the grouping, and any choice gives the same links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_place, lookup, partitions, pick, place_of, read, staged
from .components import components, forest

WORDS = 5
#: At most so many frequent shingles are told apart from the rest.
FREQUENT = 1 << 18
#: A shingle is frequent from so many sets on, counted where a task holds at least LOCAL of them.
FREQUENT_SETS = 32
LOCAL = 3
#: Min-hashes that group sets of frequent shingles, and sets compared at once.
MIN_HASHES = 4
BLOCK = 1024
#: Shingles a task counts at once.
HELD = 4_000_000
BAND = 1.25
#: Blocks of positions that a list of whole sets would have; a prefix reaches into the first fifth of these.
POSITIONS = 36
SALTS = 64
#: Texts of up to so many candidate sets are found by a broadcast of their ids, of more by a shuffle.
FETCHED = 250_000

_factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
_mask = np.uint64((1 << 62) - 1)
_top = np.int64(1 << 62)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The set of a text as sorted 62-bit hashes; empty without words. Only A-Z are lower-cased."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h)
    if n < WORDS:
        whole = (_mixed(h) * _factors[:n]).sum(keepdims=True) + np.uint64(n)
        return (_mixed(whole) & _mask).astype(np.int64)
    h = _mixed(h)
    total = h[: n - WORDS + 1] * _factors[0]
    for k in range(1, WORDS):
        total = total + h[k : n - WORDS + 1 + k] * _factors[k]
    s = np.sort((_mixed(total) & _mask).astype(np.int64))
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def class_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def frequent(texts: DataFrame) -> np.ndarray:
    """The most frequent shingles, sorted: all that occur in FREQUENT_SETS different sets or more, fewer if those were over FREQUENT."""

    def count(batches):
        held, seen, n = [], set(), 0

        def sent():
            s = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
            times = np.diff(np.append(at, len(s)))
            return pa.RecordBatch.from_arrays([pa.array(s[at[times >= LOCAL]]), pa.array(times[times >= LOCAL])], ["token", "n"])

        for batch in batches:
            for text in batch.column("text"):
                tokens = shingles(text.as_py())
                if len(tokens) and (own := class_of(tokens)) not in seen:
                    seen.add(own)
                    held.append(tokens)
                    n += len(tokens)
                    if n > HELD:
                        yield sent()
                        held, n = [], 0
        if held:
            yield sent()

    counts = staged(texts.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_SETS), "jaccard-frequent")
    sizes = {r["b"]: r["k"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()}  # 64 rows at most
    least, total = 64, 0
    for b in sorted(sizes, reverse=True):
        total += sizes[b]
        if total > FREQUENT:
            break
        least = b
    found = counts.where(F.col("n") >= F.lit(2.0**least)).select("token").toArrow()  # no Python object for each
    return np.sort(found.column("token").to_numpy().astype(np.int64))


def prefix_size(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def indexed(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, class, n, prefix, tokens, hashes) a row; prefix only on a task's first row of its class.

    tokens (the whole set) and hashes (of its frequent shingles) only where frequent shingles reach
    into the prefix.
    """
    known = texts.sparkSession.sparkContext.broadcast(common)
    mixes = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]

    def build(batches):
        freq, seen = known.value, set()
        for batch in batches:
            out = []
            for text in batch.column("text"):
                tokens = shingles(text.as_py())
                n = len(tokens)
                if not n:
                    out.append((None, 0, None, None, None))
                    continue
                own = class_of(tokens)
                if own in seen:
                    out.append((own, n, None, None, None))
                    continue
                seen.add(own)
                hot = np.zeros(n, bool)
                if len(freq):
                    hot = freq[np.minimum(np.searchsorted(freq, tokens), len(freq) - 1)] == tokens
                size = prefix_size(n)
                light = tokens[~hot]
                if len(light) >= size:
                    out.append((own, n, light[:size].tobytes(), None, None))
                else:
                    heavy = tokens[hot]
                    hashes = [int(np.min(_mixed(heavy.astype(np.uint64) * m) >> np.uint64(1))) for m in mixes]
                    out.append((own, n, np.concatenate((light, heavy[: size - len(light)] | _top)).tobytes(), tokens.tobytes(), hashes))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "class", "n", "prefix", "tokens", "hashes"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return staged(texts.mapInArrow(build, f"doc_id {kind}, class long, n int, prefix binary, tokens binary, hashes array<long>"), "jaccard-sets")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block of sets, by products of membership columns."""
    every = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    col = place[at]
    rows, col = rows[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, len(shared), 4096):
        a, b = np.searchsorted(col, (low, low + 4096))
        part = np.zeros((len(sets), min(4096, len(shared) - low)), np.float32)
        part[rows[a:b], col[a:b] - low] = 1
        out += part @ part.T
    return out


def blocked(sets: DataFrame) -> DataFrame:
    """(class, tokens, g): the blocks that sets of frequent shingles are compared in.

    Sets that share one of MIN_HASHES min-hashes are a group; a group is dealt out to blocks of
    about BLOCK sets, differently for each min-hash, so that its blocks connect.
    """
    heavy = sets.where(F.col("tokens").isNotNull()).select("class", "tokens", F.posexplode("hashes").alias("r", "key"))
    sizes = heavy.groupBy("r", "key").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    block = F.pmod(F.xxhash64("class", "r"), F.expr(f"(k + {BLOCK - 1}) div {BLOCK}"))
    return heavy.join(sizes, ["r", "key"]).select("class", "tokens", F.xxhash64("r", "key", block).alias("g"))


def block_links(rows: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of the links inside each block g of rows (g, class, tokens)."""
    spread = rows.repartition(partitions(rows.sparkSession), "g").sortWithinPartitions("g", "class")

    def compare(batches):
        def met(classes, tokens):
            ids, at = np.unique(np.array(classes), return_index=True)
            members = [np.frombuffer(tokens[i], np.int64) for i in at]
            sizes = np.array([len(m) for m in members])
            found = []
            for low in range(0, len(ids), BLOCK):  # blocks are near BLOCK in size; a larger one is compared in parts
                for high in range(low, len(ids), BLOCK):
                    x = np.arange(low, min(len(ids), low + BLOCK))
                    y = x if high == low else np.arange(high, min(len(ids), high + BLOCK))
                    both = x if high == low else np.concatenate((x, y))
                    o = overlaps([members[i] for i in both])[: len(x), len(both) - len(y) :]
                    a, b = np.nonzero(9 * o >= 4 * (sizes[x][:, None] + sizes[y][None, :]))
                    a, b = x[a], y[b]
                    found.append((a[a < b], b[a < b]))
            root = forest(*(np.concatenate(s) for s in zip(*found, strict=True)), len(ids))
            leaf = np.flatnonzero(root != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[leaf]), pa.array(ids[root[leaf]])], ["u", "v"])

        g, classes, tokens = None, [], []
        for batch in batches:
            for group, own, data in zip(batch.column("g").to_pylist(), batch.column("class").to_pylist(), batch.column("tokens"), strict=True):
                if group != g:
                    if len(classes) > 1:
                        yield met(classes, tokens)
                    g, classes, tokens = group, [], []
                if not classes or own != classes[-1]:
                    classes.append(own)
                    tokens.append(data.as_py())
        if len(classes) > 1:
            yield met(classes, tokens)

    return spread.mapInArrow(compare, "u long, v long")


def postings(sets: DataFrame) -> DataFrame:
    """(token, class, n, pos) of the index lists that hold two classes or more; positions from 1."""

    def explode(batches):
        for batch in batches:
            parts = [np.frombuffer(p.as_py(), np.int64) for p in batch.column("prefix")]
            sizes = [len(p) for p in parts]
            if parts:
                own = np.repeat(batch.column("class").to_numpy(), sizes)
                n = np.repeat(batch.column("n").to_numpy(), sizes)
                pos = np.concatenate([np.arange(1, k + 1, dtype=np.int32) for k in sizes])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(own), pa.array(n), pa.array(pos)], ["token", "class", "n", "pos"])

    def shared(batches):
        last = None  # the row that waits to see whether its list goes on, and whether it did already

        def kept(token, own, n, pos, more):
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(own), pa.array(n), pa.array(pos)], ["token", "class", "n", "pos"]).filter(pa.array(more))

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("token", "class", "n", "pos")]
            if last is not None:
                columns = [np.concatenate((a, b)) for a, b in zip(last[:4], columns, strict=True)]
            token, own = columns[0], columns[1]
            same = token[1:] == token[:-1]
            new = np.concatenate(([True], ~(same & (own[1:] == own[:-1]))))  # a class once a list
            columns = [c[new] for c in columns]
            token = columns[0]
            same = token[1:] == token[:-1]
            before = np.concatenate(([bool(last is not None and last[4])], same))
            more = before | np.concatenate((same, [False]))
            last = (*(c[-1:] for c in columns), bool(before[-1]))
            if len(token) > 1:
                yield kept(*(c[:-1] for c in columns), more[:-1])
        if last is not None and last[4]:
            yield kept(*last[:4], np.array([True]))

    kind = "token long, class long, n int, pos int"
    every = sets.where(F.col("prefix").isNotNull()).select("class", "n", "prefix").mapInArrow(explode, kind)
    hot = F.col("token") >= (1 << 62)  # lists of frequent shingles may be long: they are spread, and hold two classes in any case
    every = every.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("class"), F.lit(SALTS))).otherwise(0))
    spread = every.repartition(partitions(sets.sparkSession), "token", "salt").sortWithinPartitions("token", "class").drop("salt")

    def lists(batches):
        def light(source):
            for batch in source:
                yield batch.filter(pa.array(batch.column("token").to_numpy() < _top))

        held = []

        def heavy(source):
            for batch in source:
                own = batch.filter(pa.array(batch.column("token").to_numpy() >= _top))
                if own.num_rows:
                    held.append(own)
                yield batch

        for batch in shared(light(heavy(batches))):
            yield batch
            yield from held
            held.clear()
        yield from held

    return staged(spread.mapInArrow(lists, kind).dropDuplicates(["token", "class"]), "jaccard-lists")


def block_pairs(rows: DataFrame) -> DataFrame:
    """(token, band_a, place_a, band, place, read): pairs of a list's blocks of like size, and whether their bounds leave room for a link.

    ``rows`` has token, band, place, n, pos and asks. The first block of a pair has entries that ask.
    """
    rest = F.col("n") - F.col("pos")
    kept = rows.groupBy("token", "band", "place").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("pos").alias("pos"), F.max(rest).alias("rest"), F.max("asks").alias("asks")
    )
    near = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    ask = kept.where("asks").select("token", F.col("band").alias("band_a"), "place", "low", "high", "pos", "rest", near.alias("band"))
    ask = ask.select("token", "band", "band_a", *(F.col(c).alias(f"{c}_a") for c in ("place", "low", "high", "pos", "rest")))
    sizes = (5 * F.col("high_a") >= 4 * F.col("low")) & (5 * F.col("high") >= 4 * F.col("low_a"))
    room = F.least("pos", "pos_a") + F.least("rest", "rest_a") >= F.ceil(F.lit(4) * (F.col("low") + F.col("low_a")) / F.lit(9))
    return kept.join(ask, ["token", "band"]).select("token", "band_a", "place_a", "band", "place", (sizes & room).alias("read"))


def candidates(lists: DataFrame, member: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): pairs of classes of different components whose prefixes leave room for a link."""
    blocks = blocked(sets).groupBy("class").agg(F.collect_set("g").alias("blocks"))
    rows = (
        lists.join(member.withColumnRenamed("id", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class"))
        .join(blocks, "class", "left")
        .withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
        .withColumn("place", F.floor(F.lit(POSITIONS) * F.col("pos") / F.col("n")).cast("int"))
    )
    rows = staged(rows, "jaccard-entries")
    parts = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = parts.groupBy("token").agg(F.max(F.struct("k", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", F.col("m.component").alias("largest"))
    open_rows = staged(rows.join(largest, "token").withColumn("asks", F.col("component") != F.col("largest")), "jaccard-open")
    ask = (
        open_rows.where("asks")
        .select("token", F.col("band").alias("band_a"), F.col("place").alias("place_a"), *(F.col(c).alias(f"{c}_a") for c in ("class", "n", "pos", "component", "blocks")))
        .join(block_pairs(open_rows).where("read").drop("read"), ["token", "band_a", "place_a"])
    )
    answer = open_rows.select("token", "band", "place", "largest", "class", "n", "pos", "component", "blocks")
    together = F.coalesce(F.arrays_overlap("blocks", "blocks_a"), F.lit(False))  # compared in a block already
    needed = F.ceil(F.lit(4) * (F.col("n") + F.col("n_a")) / F.lit(9))
    room = F.least("pos", "pos_a") + F.least(F.col("n") - F.col("pos"), F.col("n_a") - F.col("pos_a"))
    met = answer.join(ask, ["token", "band", "place"]).where(
        (F.col("component") != F.col("component_a"))
        & ((F.col("component") == F.col("largest")) | (F.col("class_a") < F.col("class")))
        & (5 * F.least("n", "n_a") >= 4 * F.greatest("n", "n_a"))
        & (room >= needed)
        & ~together
    )
    # beyond the prefix that ends first, its set has ceil(0.8 n) - 1 shingles left to share
    beyond = F.ceil(F.lit(4) * F.greatest("n", "n_a") / F.lit(5)) - 1
    pairs = met.groupBy(F.least("class", "class_a").alias("a"), F.greatest("class", "class_a").alias("b")).agg(
        F.count(F.lit(1)).alias("common"),
        F.first(F.col("n") + F.col("n_a")).alias("both"),
        F.min(F.least(beyond, F.col("n") - F.col("pos"), F.col("n_a") - F.col("pos_a"))).alias("rest"),
    )
    return pairs.where(9 * (F.col("common") + F.col("rest")) >= 4 * F.col("both")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v): a forest that spans the links among the pairs, by whole sets computed again from one text each.

    Pairs make families (components of candidates). A set goes to its family's block once, or, in a
    family of over BLOCK sets, to each pair of blocks that holds a candidate pair.
    """
    member = staged(components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))), "jaccard-families")
    blocks = member.groupBy("component").agg(F.expr(f"(count(1) + {BLOCK - 1}) div {BLOCK}").alias("k"))
    placed = member.join(blocks, "component").select(F.col("id").alias("class"), "component", F.pmod(F.xxhash64("id"), F.col("k")).alias("block"))
    ends = pairs.join(placed.select(F.col("class").alias("a"), "component", F.col("block").alias("x")), "a").join(placed.select(F.col("class").alias("b"), F.col("block").alias("y")), "b")
    needed = ends.select("component", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    routes = needed.select("component", F.xxhash64("component", "x", "y").alias("g"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))

    one = sets.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("__id"))  # before the join, so that a task sends a hot class once
    one = staged(one.join(placed.select("class"), "class", "left_semi"), "jaccard-wanted")
    if one.count() <= FETCHED:
        one = F.broadcast(one)

    def build(batches):
        for batch in batches:
            found = [shingles(t.as_py()) for t in batch.column("text")]
            own = [class_of(f) if len(f) else None for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("class"), pa.array(own, pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["class", "own", "tokens"])

    fetched = texts.join(one, F.col("doc_id").eqNullSafe(F.col("__id"))).select("class", "text").mapInArrow(build, "class long, own long, tokens binary")
    whole = staged(fetched.where("class = own").select("class", "tokens"), "jaccard-whole")
    return block_links(whole.join(placed.join(routes, ["component", "block"]).select("class", "g"), "class").select("g", "class", "tokens"))


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links reach, itself included; rows without words link with
    nothing. Null ids lose to any id and keep a null component_id only among themselves. Rows that
    repeat a text are in one component. An empty table gives no rows. Shingles are told apart by
    62-bit hashes and sets by 64-bit digests.
    """
    texts = pick(docs, doc_id=id_col, text=text_col)
    sets = indexed(texts, frequent(texts))
    blocks = staged(block_links(blocked(sets)), "jaccard-blocks")
    pairs = staged(candidates(postings(sets), components(blocks), sets), "jaccard-pairs")
    found = staged(verified(pairs, sets, texts), "jaccard-links")
    member = components(blocks.unionByName(found)).withColumnRenamed("id", "class")
    grouped = sets.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("rows"))
    classes = staged(grouped.join(member, "class", "left").withColumn("component", F.coalesce("component", "class")), "jaccard-classes")
    smallest = classes.groupBy("component").agg(F.min("smallest").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = lookup(classes.select("class", "component", "rows"), smallest, ["component"], "classes").drop("component")
    narrow = sets.select("doc_id", "class", F.col("n").cast("long").alias("n_shingles"))
    found = lookup(narrow.where("n_shingles > 0"), named, ["class"], "rows").select("doc_id", "n_shingles", "component_id")
    return found.unionByName(narrow.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id names their component, with all their columns: the pipeline's form of the operator.

    Rows without words stay. Rows that repeat an id that stays, stay with it; null ids stay where a component has
    no other. An empty table gives no rows. Extra columns of any name stay.
    """
    keep = jaccard_components(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return by_place(docs).join(keep, F.col(place_of(docs, "doc_id")).eqNullSafe(F.col("doc_id")), "left_semi").toDF(*docs.columns)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM s),
x AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM x a JOIN x b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM common JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
reached AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
smallest AS (SELECT u, min(v) AS low FROM reached GROUP BY u)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id FROM n LEFT JOIN smallest ON u = doc_id
"""
