"""Mixing sources to target weights by systematic sampling; DataFrame operations only.

Every document of a source has the same expected number of copies, its source's target over its size. Documents are
put in order within the source, expected copies are added up along that order, one random offset is added, and a
document is emitted once for each whole number that its interval reaches. Ordering by size makes the draw a
stratified one, so that the words taken differ from the target by little more than one long document.

The running sum needs each document's place in its source. No source is gathered for that: places are counted per
(source, size), then per leading digits of the documents' hashes, and only rows that agree in all of these are ranked.

Defined cases: a null or blank text has size 0 and keeps its place; a null source is a source of its own, last; null
ids are one more id; equal rows are told apart only by their number; no rows, or no words at all, give targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from evenhand.llm.catalog import register
from evenhand.llm.common import read, word_count

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3.0
SEED = "mix"
# Leading hash digits that split documents of one source and size: 16^3 parts.
DIGITS = 3
_OWN = "_mix_"


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """For rows (source, size), one per source: source_size and target.

    Weights repeat along the sources in code point order, nulls last. All words are shared by weight; a source stops at
    ``most`` times its size and its excess goes to the others by weight. Filling sources in the order of limit over
    weight finds the level at which the rest share: a source is full if the level, were it the first not to be, exceeds its ratio.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    # One row per source here, so these windows hold no documents.
    place = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    rows = sizes.withColumn("at", F.row_number().over(place) - 1)
    rows = rows.withColumn("weight", F.get(listed, F.col("at") % len(weights)))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "at")
    before, rest, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("weight").over(rest)).withColumn("step", F.row_number().over(fill))
    rows = rows.withColumn("full", F.col("level") > F.col("most") / F.col("weight"))
    common = F.min(F.when(~F.col("full"), F.struct("step", "level"))).over(whole)["level"]
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least("most", F.col("common") * F.col("weight")))
    return rows.withColumn("common", common).select("source", "source_size", target.alias("target"))


def _offset(key: Column, seed: str) -> Column:
    """A number in [0, 1) for each source key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**8))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_COPIES, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``copies``; documents with 0 copies stay in the result.

    Own columns of the input with these names are replaced. Use :func:`emit` to get each document as often as it was drawn.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    # A null source gets a key that no other has, so that joins and windows deal rows out by the same columns.
    name = F.col(source_col).cast("string")
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keys = [f"{_OWN}source", f"{_OWN}size", f"{_OWN}part"]
    of_key = {keys[0]: F.coalesce(F.concat(F.lit("s"), name), F.lit("")), keys[1]: word_count(F.col(text_col)), keys[2]: F.substring(digest, 1, DIGITS)}
    parts = docs.select(*[v.alias(k) for k, v in of_key.items()]).groupBy(*keys).agg(F.count("*").alias("n"))
    # (source, size) pairs: at most as many in a source as documents have lengths.
    pairs = parts.groupBy(*keys[:2]).agg(F.sum("n").alias("n"))
    sizes = pairs.groupBy(keys[0]).agg(F.sum(F.col(keys[1]) * F.col("n")).alias("source_size"))
    sizes = sizes.select(F.when(F.col(keys[0]) != "", F.substr(keys[0], F.lit(2))).alias("source"), "source_size")
    targets = source_targets(sizes, weights, most).withColumn(keys[0], F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))).drop("source")
    by_size = Window.partitionBy(keys[0]).orderBy(keys[1]).rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("shorter", F.coalesce(F.sum("n").over(by_size), F.lit(0))).drop("n").join(targets, keys[0])
    by_part = Window.partitionBy(*keys[:2]).orderBy(keys[2]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("earlier", F.coalesce(F.sum("n").over(by_part), F.lit(0))).drop("n")
    found = parts.join(pairs, keys[:2]).select(*keys, (F.col("earlier") + F.col("shorter")).alias("start"), "source_size", "target")

    rows = docs.select(*[F.col(f"`{c}`") for c in kept]).withColumns({**of_key, f"{_OWN}digest": digest})
    ties = Window.partitionBy(*keys).orderBy(f"{_OWN}digest", F.col(id_col))
    rows = rows.withColumn(f"{_OWN}row", F.row_number().over(ties))
    drawn = rows.alias("r").join(found.alias("f"), keys)
    at = F.col("f.start") + F.col(f"r.{_OWN}row")
    expected = F.when(F.col("f.source_size") > 0, F.col("f.target") / F.col("f.source_size")).otherwise(F.lit(0.0))
    offset = _offset(F.col(keys[0]), seed)
    copies = F.floor(offset + at * expected) - F.floor(offset + (at - 1) * expected)
    copies = F.least(copies, F.lit(int(most))).cast("long")
    return drawn.select(*[F.col(f"r.`{c}`") for c in kept], F.col(keys[1]).alias("size"), F.col("f.source_size"), F.col("f.target"), copies.alias("copies"))


def emit(drawn: DataFrame) -> DataFrame:
    """Each row as often as ``copies`` says, without the columns that the draw added."""
    kept = [F.col(f"`{c}`") for c in drawn.columns if c not in ("size", "source_size", "target", "copies")]
    repeated = F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))
    return drawn.where("copies > 0").withColumn(f"{_OWN}copy", repeated).select(*kept)


ORACLE = r"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sized AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + spot % 3] AS weight, source_size * 3.0::DOUBLE AS most
  FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS spot FROM sized)),
levels AS (SELECT *, ((SELECT sum(source_size) FROM sized) - coalesce(sum(most) OVER (ORDER BY most / weight, spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY most / weight, spot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM weighed),
common AS (SELECT arg_min(lev, most / weight) AS common FROM levels WHERE NOT lev > most / weight),
targets AS (SELECT source, source_size, CASE WHEN lev > most / weight THEN most ELSE least(most, common * weight) END AS target FROM levels, common),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(CAST(doc_id AS VARCHAR)), doc_id) AS spot FROM docs),
drawn AS (SELECT doc_id, size, source_size, target, spot, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS expected,
  CAST(('0x' || substr(md5('mix:' || coalesce('s' || r.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS start
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(least(floor(start + spot * expected) - floor(start + (spot - 1) * expected), 3) AS BIGINT) * size AS taken FROM drawn
"""


@register("op8_mix", ORACLE)
def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    drawn = mix_sources(docs)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
