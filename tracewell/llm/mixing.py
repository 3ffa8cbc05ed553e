"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document waits in its source's queue, in the order of a digest of its id, and the queue is
served ``passes`` times. A document's virtual finish time is the cumulative number of its source's
words up to its end, divided by the source's weight. All services are ordered by finish time across
sources and taken until the next would exceed the budget. A source whose queue runs dry leaves its
share to the others by weight, so the shares come out as water-filling under the caps.

No sum runs over a whole source or the whole table in one task. Cumulative words within a source are
a running sum inside one of ``BUCKETS`` digest ranges plus the sum of the ranges before. The global
order is cut into ranges of finish time around the fluid cut-off (which has a closed form over the
source summary); only the range in which the budget ends is sorted, and it holds about 1/RANGES of
the budget because the rate of service never rises.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, by_place, pick, place_of, read, staged

#: Digest ranges of a source (three hex digits).
BUCKETS = 4096
#: Repeats of a row that one task unfolds.
FOLD = 4096
#: Ranges of finish time up to the fluid cut-off; as many lie beyond it.
RANGES = 16384
WEIGHTS = (5, 2, 1)


def source_plan(sized: DataFrame, weights: tuple[int, ...], budget_share: float, passes: int) -> DataFrame:
    """One row per source: place (by code point, null last), weight, source_size, target, level.

    level is the virtual time at which fluid service has used the whole budget. One row per source
    is all that its windows order.
    """
    by_place = W.orderBy(F.col("source").isNull(), "source")
    by_cap = W.orderBy(F.col("cap") / F.col("weight"), "place")
    every = W.partitionBy()
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, W.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_place))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * passes)
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(budget_share)))
        .withColumn("tried", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("level", F.min(F.when(F.col("tried") <= F.col("full_at"), F.struct("full_at", "place", "tried"))).over(every)["tried"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))
        .select("source", "place", "weight", "source_size", "target", "level", "budget")
    )


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, budget_share: float = 1.5, passes: int = 2, seed: str = "0", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, digest, size, source_size, target, taken.

    size counts words (null text: 0); taken is size times the number of services inside the budget.
    Documents are taken whole, so a source ends within one document of its target. Null source is a
    source of its own, last. Rows with a null id queue by a digest of their text. Rows that repeat an id queue next
    to each other by size; those that repeat id and text are folded, so no task orders them one by one. Empty texts take nothing. An empty table gives no rows. The order depends
    on ids and ``seed`` alone, so reruns agree.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    sized = staged(
        rows.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")).cast("binary")))))).alias("digest"),
            F.xxhash64("text").alias("row_key"),
        ).withColumn("bucket", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int")),
        "mix-sized",
    )
    plan = staged(source_plan(sized, weights, budget_share, passes), "mix-sources")

    in_source = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = (
        sized.groupBy("source", "bucket")
        .agg(F.sum("size").alias("n"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(in_source), F.lit(0)))
        .select(F.col("source").alias("s"), F.col("bucket").alias("b"), "ahead")
    )
    row = ["doc_id", "source", "digest", "row_key", "size"]
    folded = sized.groupBy(*row, "bucket").agg(F.count(F.lit(1)).alias("times"))
    running = W.partitionBy("source", "bucket").orderBy("digest", "size", "row_key").rowsBetween(W.unboundedPreceding, 0)
    ended = (
        folded.withColumn("here", F.sum(F.col("size") * F.col("times")).over(running))
        .join(ahead, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .select(*row, "times", (F.col("ahead") + F.col("here")).alias("last"))
    )
    parts = ended.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / FOLD))))
    spread = parts.where(F.col("times") <= FOLD).unionByName(parts.where(F.col("times") > FOLD).repartition("digest", "part"))
    nth = F.sequence(F.col("part") * FOLD + 1, F.least((F.col("part") + 1) * FOLD, F.col("times")))
    queued = staged(spread.withColumn("nth", F.explode(nth)).select(*row, (F.col("last") - (F.col("times") - F.col("nth")) * F.col("size")).alias("cum")), "mix-queued")

    of_source = plan.withColumnRenamed("source", "s")
    services = (
        queued.where("size > 0").select("source", "size", "cum")
        .join(of_source, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(passes)])))
        .withColumn("end", F.col("pass") * F.col("source_size") + F.col("cum"))
        .withColumn("finish", F.col("end") / F.col("weight"))
        .select("place", "size", "end", "finish", "budget", F.least(F.lit(2 * RANGES), F.floor(F.col("finish") / F.col("level") * RANGES)).alias("range"))
    )
    ranges = services.groupBy("range").agg(F.sum("size").alias("n"), F.max("budget").alias("budget"))
    cut = ranges.withColumn("sum", F.sum("n").over(W.orderBy("range"))).where("sum > budget").agg(F.min(F.struct("range", (F.col("sum") - F.col("n")).alias("before"))).alias("cut"))
    at = cut.select(F.coalesce("cut.range", F.lit(4 * RANGES)).alias("last"), F.coalesce("cut.before", F.lit(0)).alias("before")).first()  # one row of two numbers
    inside = services.where(F.col("range") < at["last"]).select("place", "end")
    edge = (
        services.where(F.col("range") == at["last"])
        .withColumn("sum", F.lit(at["before"]) + F.sum("size").over(W.orderBy("finish", "place", "end").rowsBetween(W.unboundedPreceding, 0)))
        .where(F.col("sum") <= F.col("budget"))
        .select("place", "end")
    )
    served = inside.unionByName(edge).groupBy("place").agg(F.max("end").alias("served"))
    done = of_source.join(served, "place", "left")
    times = sum((F.when(F.col("cum") + F.lit(p) * F.col("source_size") <= F.col("served"), 1).otherwise(0) for p in range(passes)), F.lit(0))
    return queued.join(done, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "digest", "row_key", "size", "source_size", "target", (F.col("size") * times).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes it, in all their columns: the pipeline's form.

    A row is found again by its id (null ids too) and a hash of its text; of repeated rows each is as often there
    as the most taken of them. Rows without words are not taken. An empty table gives no rows. Extra columns
    of any name stay.
    """
    taken = mix(docs).where("taken > 0").groupBy("doc_id", "row_key").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("times"))
    found = by_place(docs).join(taken, F.col("doc_id").eqNullSafe(F.col(place_of(docs, "doc_id"))) & (F.col("row_key") == F.xxhash64(place_of(docs, "text"))))
    each = found.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return each.drop("turn", "doc_id", "row_key", "times").toDF(*docs.columns)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS digest,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS place FROM sized GROUP BY source),
weighted AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget FROM src),
tried AS (
  SELECT *, (budget - coalesce(CAST(sum(cap) OVER (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(weight) OVER (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT)::DOUBLE AS level
  FROM weighted),
lev AS (SELECT arg_min(level, cap / weight::DOUBLE) AS level FROM tried WHERE level <= cap / weight::DOUBLE),
plan AS (SELECT w.*, least(cap::DOUBLE, lev.level * weight) AS target FROM weighted w, lev),
queued AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY digest, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM sized),
served AS (
  SELECT q.doc_id, q.source, q.size, p.place, p.budget, k.pass * p.source_size + q.cum AS fin,
         (k.pass * p.source_size + q.cum) / p.weight::DOUBLE AS finish
  FROM queued q JOIN plan p ON q.source IS NOT DISTINCT FROM p.source, (VALUES (0), (1)) AS k(pass) WHERE q.size > 0),
summed AS (
  SELECT place, fin, budget, sum(size) OVER (ORDER BY finish, place, fin ROWS UNBOUNDED PRECEDING) AS total FROM served),
cut AS (SELECT place, max(fin) AS served FROM summed WHERE total <= budget GROUP BY place)
SELECT q.doc_id, q.size, p.source_size, p.target,
       CAST(q.size * ((CASE WHEN q.cum <= c.served THEN 1 ELSE 0 END) + (CASE WHEN q.cum + p.source_size <= c.served THEN 1 ELSE 0 END)) AS BIGINT) AS taken
FROM queued q JOIN plan p ON q.source IS NOT DISTINCT FROM p.source LEFT JOIN cut c ON c.place = p.place
"""
