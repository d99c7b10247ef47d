"""Mixing sources to target weights: token totals per source give repetition rates; a document is taken floor(rate) times and once more with the fraction's probability, drawn from a hash of its id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ranges
from .common import Scratch, prepare, removed, text_column, written

#: Sources by code point (null last) have these weights, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: The mix takes this share of all words; a source at most so many times its own.
SHARE, MOST = 1.5, 2.0
SEED = "mix-1"
#: Of so many seeds a source uses the one whose draws come nearest to its target.
SEEDS = 16
#: A table of more sources than this is joined by a shuffle, not a broadcast.
MOST_BROADCAST = 100_000


def size_of(text):
    """Number of words: runs of characters other than ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals(source, source_size) -> the same with target and rate.

    Sources are filled by weight up to their limits: in order of limit / weight, a source is at its limit if the level that the
    rest would share by weight is not below its own. Places and running sums come from parallel ranges, as there may be a source a host.
    """
    keyed = totals.select("source", "source_size", F.col("source").isNull().cast("int").alias("no_source"), F.col("source").cast("binary").alias("code"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    limited = ranges.row_index(keyed, ["no_source", "code"], "place").withColumn("weight", pick).withColumn("ratio", most * F.col("source_size") / F.col("weight"))
    summed = ranges.scan(limited, ["ratio", "place"], ranges.sum_value("source_size", "size_so_far"), ranges.sum_value("weight", "weight_so_far"))
    all_of = limited.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))  # one row
    level = (share * F.col("all_size") - most * (F.col("size_so_far") - F.col("source_size"))) / (F.col("all_weight") - F.col("weight_so_far") + F.col("weight"))
    levelled = summed.crossJoin(all_of).withColumn("level", level)
    final = levelled.agg(F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).alias("final"))  # one row
    target = F.when(F.col("ratio") > F.coalesce("final", F.lit(float("inf"))), F.col("weight") * F.col("final")).otherwise(most * F.col("source_size"))
    return levelled.crossJoin(final).withColumn("target", target).select("source", "source_size", "target", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("rate"))


def copies_of(rate, doc_id, seed):
    """floor(rate) copies, and one more if the id's hash as a number in [0, 1) is below the fraction."""
    text = F.concat(F.lit(SEED + ":"), seed.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("long")


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(source, ...) with the plan's columns; the plan has a row per source and is broadcast if those are few."""
    few = plan.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    right = plan.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def planned(sized: DataFrame) -> DataFrame:
    """sized(doc_id, source, size) -> source, source_size, target, rate and seed of each source."""
    scratch = Scratch(sized.sparkSession)
    totals = scratch.written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "totals")
    plan = scratch.written(targets(totals), "targets")
    taken = [F.sum(F.col("size") * copies_of(F.col("rate"), F.col("doc_id"), F.lit(k))) for k in range(SEEDS)]
    misses = F.array(*(F.struct(F.abs(x - F.first("target")).alias("miss"), F.lit(k).alias("seed")) for k, x in enumerate(taken)))
    seeds = _joined(sized, plan).groupBy(F.col("source").alias("s")).agg(F.array_min(misses)["seed"].alias("seed"))
    out = written(plan.join(seeds, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "plan")
    scratch.close()
    return out


def _sized(documents: DataFrame) -> DataFrame:
    return written(documents.select("doc_id", F.col("source").cast("string").alias("source"), size_of(text_column(documents)).alias("size")), "sized")


def mix_table(documents: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of every row.

    A null or empty text has size 0 and is taken as any other, for no words. A null source is a source. Repeated rows draw alike, as they share
    their id; a null id draws as one of its own. If all texts are empty all targets are 0. An empty table gives an empty table.
    """
    prepare(documents.sparkSession)
    sized = _sized(documents)
    taken = copies_of(F.col("rate"), F.col("doc_id"), F.col("seed")) * F.col("size")
    return _joined(sized, planned(sized)).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def mixed(documents: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as given.

    A null or empty text has size 0 and is taken at its source's rate; a null source is a source, a null id draws as one of its own, repeated rows draw
    alike. Without words in any text no document is taken. An empty table gives an empty table; extra columns stay, whatever their names.
    """
    rows = documents.select(F.struct(*(documents[c] for c in documents.columns)).alias("__row"), F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"))
    sized = _sized(documents)
    plan = planned(sized)
    removed(documents.sparkSession, sized)
    many = _joined(rows, plan).withColumn("copies", copies_of(F.col("rate"), F.col("doc_id"), F.col("seed"))).where("copies > 0")
    return many.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("__row.*")


#: DuckDB SQL for mix_table.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::BIGINT] AS weight FROM t
), r AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
    - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY ratio, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), f AS (
  SELECT *, max(CASE WHEN ratio > level THEN level END) OVER () AS final FROM l
), g AS (
  SELECT source, source_size, CASE WHEN ratio > coalesce(final, 'inf'::DOUBLE) THEN weight * final ELSE 2.0::DOUBLE * source_size END AS target FROM f
), h AS (
  SELECT d.doc_id, d.size, d.source, g.source_size, g.target, CASE WHEN g.source_size = 0 THEN 0.0::DOUBLE ELSE g.target / g.source_size END AS rate
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), x AS (
  SELECT h.*, seed, CAST((floor(rate) + CASE WHEN CAST('0x' || substr(md5('mix-1:' || CAST(seed AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
  FROM h CROSS JOIN (SELECT unnest(range(16)) AS seed)
), m AS (
  SELECT source, seed, abs(sum(taken)::DOUBLE - any_value(target)) AS miss FROM x GROUP BY 1, 2
), b AS (
  SELECT source, seed FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY miss, seed) = 1
)
SELECT doc_id, size, source_size, target, taken FROM x JOIN b ON x.source IS NOT DISTINCT FROM b.source AND x.seed = b.seed
"""
