"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected to be taken e = target / size times.  The documents of a source stand in one
order, the expected copies are summed along it from a random start in [0, 1), and a document is taken once for every
integer that its own step crosses.  So no document is taken fewer than floor(e) or more than ceil(e) times.

The order runs through bands of similar size (eight to a factor of two), so that few large documents don't shift the
words of a source.  A document's place is found without sorting a source in one task: counts of (source, band,
bucket) are summed along the source, and only the at most few thousand rows of a bucket are ranked.  A source that
holds a third of the rows is just more buckets.

Words are counted once, into a table without texts.  mixed_documents() numbers the rows first, and joins the copies by
that number, so texts go through one exchange, and no key has more than one row.

Defined results: a null or empty text has size 0 and takes part with 0 words; a null source is a source, the last; rows
without doc_id are told apart by their text; repeated rows are separate documents; an empty table gives no rows; other
columns than the three named ones don't matter.
"""

from __future__ import annotations

import contextlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, stored

#: Rows that one ranking bucket is meant to hold.
BUCKET_ROWS = 4096


def targets(per_source: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """The words each source should give: `share` of all by weight, none above `cap` times its own.

    Sources fill up in the order of cap / weight.  With those before it full, source i's level is what remains over
    the weights that remain; the level of the whole is that of the first source which isn't full.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), "source")
    all_rows = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    out = per_source.withColumn("w", w).withColumn("most", cap * F.col("source_size"))
    out = out.withColumn("ratio", F.col("most") / F.col("w")).withColumn("wanted", share * F.sum("source_size").over(all_rows))
    full = F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most")
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (F.col("wanted") - full) / rest)
    level = F.max(F.when(F.col("level") < F.col("ratio"), F.col("level"))).over(all_rows)
    out = out.withColumn("at", level)
    target = F.when(F.col("at").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("at") * F.col("w")))
    return out.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    keep: tuple[str, ...] = (),
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 1,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken and the (narrow) columns in `keep`."""
    number = F.col("doc_id").cast("long")
    spread = F.when(number.isNotNull(), F.pmod(number, F.lit(1 << 31))).otherwise(F.conv(F.substring(F.md5(F.coalesce("text", F.lit(""))), 1, 7), 16, 10).cast("long"))
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.pmod(spread * F.lit(2654435761), F.lit(1 << 32)).alias("spread"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    )
    sized = cut(sized)
    octave = F.length(F.bin("size")) - 1
    step = F.floor(F.col("size") * 8 / F.pow(F.lit(2.0), octave)).cast("int")
    band = F.when(F.col("size") == 0, F.lit(-1)).otherwise(octave * 8 + step - 8)
    sized = sized.withColumn("band", band)
    cells = cut(sized.groupBy("source", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    goal = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, cap)
    goal = goal.select(F.col("source").alias("s"), "source_size", "target")
    cells = cells.join(goal, F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.col("band").alias("b"), F.ceil(F.col("n") / BUCKET_ROWS).cast("long").alias("buckets"), "source_size", "target"
    )
    placed = sized.join(cells, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b"))).drop("s", "b")
    placed = placed.withColumn("bucket", F.pmod(F.floor(F.col("spread") / 256), F.col("buckets")))
    counts = placed.groupBy("source", "band", "bucket").agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy("source").orderBy(F.col("band").desc(), "bucket").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select(F.col("source").alias("s"), F.col("band").alias("b"), F.col("bucket").alias("k"), (F.sum("n").over(along) - F.col("n")).alias("before"))
    placed = placed.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("band") == F.col("b")) & (F.col("bucket") == F.col("k"))).drop("s", "b", "k")
    own = Window.partitionBy("source", "band", "bucket").orderBy("doc_id", "size", "spread")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    start = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    each = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size"))
    placed = placed.withColumn("place", F.col("before") + F.row_number().over(own)).withColumn("start", start).withColumn("each", each)
    copies = F.floor(F.col("start") + F.col("each") * F.col("place")) - F.floor(F.col("start") + F.col("each") * (F.col("place") - 1))
    placed = placed.withColumn("copies", copies.cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["kept"] if keep else []))


def scanned(docs: DataFrame) -> bool:
    """Whether each row stands for one row of a file: only projections and filters above one scan."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def identified(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, "own file" and "own row": the place in the file that they are read from.  Rows
    that don't come straight from Parquet files are written first."""
    place = [F.xxhash64("_metadata.file_path").alias("own file"), F.col("_metadata.row_index").alias("own row")]
    if scanned(docs):
        with contextlib.suppress(AnalysisException):  # other formats don't number their rows
            return docs.select(*docs.columns, *place)
    return stored(docs, "rows").select(*docs.columns, *place)


def mixed_documents(docs: DataFrame, columns: list[str], **options) -> DataFrame:
    """The mix itself: each document's row as often as it is taken."""
    key = ["own file", "own row"]
    rows = identified(docs)
    taken = mix(rows, keep=tuple(key), **options).where("copies > 0").select("kept.*", F.col("copies").cast("int").alias("own copies"))
    return rows.select(*columns, *key).join(taken, key).select(*columns, F.explode(F.array_repeat(F.lit(0), F.col("own copies"))).alias("own copy")).select(*columns)


#: The same in DuckDB's SQL over `documents`, with the production parameters.
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
    coalesce(((doc_id % 2147483648) + 2147483648) % 2147483648, ('0x' || substr(md5(coalesce(text, '')), 1, 7))::BIGINT) * 2654435761 % 4294967296 AS spread FROM documents
), banded AS (
  SELECT *, CASE WHEN size = 0 THEN -1 ELSE (length(bin(size)) - 1) * 8 + floor(size * 8 / pow(2.0, length(bin(size)) - 1))::INT - 8 END AS band FROM sized
), cells AS (
  SELECT source, band, count(*) AS n, sum(size)::BIGINT AS words FROM banded GROUP BY ALL
), per_source AS (
  SELECT source, sum(words)::BIGINT AS source_size FROM cells GROUP BY ALL
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS most,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w,
    1.5::DOUBLE * sum(source_size) OVER () AS wanted
  FROM per_source
), levels AS (
  SELECT *, most / w AS ratio FROM weighed
), levelled AS (
  SELECT *, (wanted - (sum(most) OVER (ORDER BY ratio, source IS NULL, source ROWS UNBOUNDED PRECEDING) - most))
    / sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM levels
), aimed AS (
  SELECT source, source_size, coalesce(least(most, max(CASE WHEN level < ratio THEN level END) OVER () * w), most) AS target FROM levelled
), placed AS (
  SELECT d.*, g.source_size, g.target,
    (d.spread // 256) % ceil(c.n / {BUCKET_ROWS})::BIGINT AS bucket
  FROM banded d JOIN cells c ON d.source IS NOT DISTINCT FROM c.source AND d.band = c.band JOIN aimed g ON d.source IS NOT DISTINCT FROM g.source
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY band DESC, bucket, doc_id NULLS FIRST, size, spread) AS place,
    ('0x' || substr(md5('1:' || coalesce('=' || source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start,
    CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size END AS each
  FROM placed
), copied AS (
  SELECT *, (floor(start + each * place) - floor(start + each * (place - 1)))::BIGINT AS copies FROM ranked
)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM copied
"""
