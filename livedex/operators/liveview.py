"""Last-writer-wins live views over change streams, whole or in tiers.

The reduction is an aggregate (max_by), so each task keeps one row per uid before the shuffle, and uids with very many
changes don't weigh on one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import TIERS


def order() -> Column:
    """Changes are ordered by version, and by arrival within a version."""
    return F.struct("version", "seq")


def latest(changes: DataFrame) -> DataFrame:
    """The last change of each uid, whatever it is."""
    rest = [c for c in changes.columns if c != "uid"]
    return changes.groupBy("uid").agg(F.max_by(F.struct(*rest), order()).alias("last")).select("uid", *[F.col(f"last.{c}").alias(c) for c in rest])


def latest_by_window(changes: DataFrame) -> DataFrame:
    """The same by rank; Spark keeps only the first row of each group while sorting."""
    by_uid = Window.partitionBy("uid").orderBy(F.col("version").desc(), F.col("seq").desc())
    return changes.withColumn("place", F.row_number().over(by_uid)).where("place = 1").drop("place")


def effective(changes: DataFrame) -> DataFrame:
    """Changes that aren't skipped."""
    return changes.where("NOT is_skip")


def live(changes: DataFrame, honor_deletes: bool = True) -> DataFrame:
    """The live view: each uid's last change that wasn't skipped, unless it is a delete."""
    last = latest(effective(changes))
    return last.where("NOT is_deleted") if honor_deletes else last


def documents(live_rows: DataFrame, docs: str = "docs") -> DataFrame:
    """One row per document of each uid."""
    rest = [c for c in live_rows.columns if c != docs]
    return live_rows.select(*rest, F.posexplode(docs).alias("doc_ord", "doc"))


def in_tier(changes: DataFrame, *tiers: str) -> DataFrame:
    return changes.where(F.col("tier").isin(*tiers))


def touched(changes: DataFrame, *tiers: str) -> DataFrame:
    """Uids that the tiers changed in any way; a delete hides older rows as much as an upsert does."""
    return effective(in_tier(changes, *tiers)).select("uid").distinct()


def newer(tier: str) -> tuple[str, ...]:
    return TIERS[: TIERS.index(tier)]


def visible(changes: DataFrame, tier: str) -> DataFrame:
    """A tier's live rows that no newer tier hides."""
    own = live(in_tier(changes, tier))
    return own.join(touched(changes, *newer(tier)), "uid", "left_anti") if newer(tier) else own


def hidden(changes: DataFrame, tier: str) -> DataFrame:
    """A tier's live rows that a newer tier hides."""
    return live(in_tier(changes, tier)).join(touched(changes, *newer(tier)), "uid", "left_semi")


def merged(changes: DataFrame, dedup: bool = True) -> DataFrame:
    """All tiers' rows: each tier without what newer tiers hide, or everything."""
    out = None
    for tier in TIERS:
        rows = visible(changes, tier) if dedup else live(in_tier(changes, tier))
        out = rows if out is None else out.unionByName(rows)
    return out


def applied(base: DataFrame, batch: DataFrame) -> DataFrame:
    """A view after one batch of changes: rows of its uids go, and its live rows come."""
    gone = effective(batch).select("uid").distinct()
    return base.join(gone, "uid", "left_anti").unionByName(live(batch).select(*base.columns))


def watermark(changes: DataFrame) -> DataFrame:
    """The highest version, of all changes and of those with an effect.  Skipped changes advance it too."""
    return changes.agg(F.max("version").alias("version"), F.max(F.when(~F.col("is_skip"), F.col("version"))).alias("effective_version"))


def as_of(changes: DataFrame, version: int) -> DataFrame:
    return live(changes.where(F.col("version") <= version))
