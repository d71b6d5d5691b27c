"""Keyed state in batch form: latest per key, expiry, caches, version guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import cache_key


def live_states(entries: DataFrame, key: str, order: str, now: str) -> DataFrame:
    """The latest entry of each key that hasn't expired: ``now >= expires_at`` is expired."""
    columns = [c for c in entries.columns if c != key]
    latest = entries.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("row")).select(key, "row.*")
    return latest.where(F.col("expires_at") > F.lit(now).cast(entries.schema["expires_at"].dataType))


def summary_keys(groups: DataFrame, group: str, member: str) -> DataFrame:
    """``(group, key, members)``: hash of the distinct members, sorted and joined by NUL.

    The key is defined over the whole list, so a group's distinct ids meet in one task; copies are gone before.
    """
    once = groups.select(group, member).distinct()
    return once.groupBy(group).agg(cache_key(F.collect_list(member)).alias("key"), F.count("*").alias("members"))


def evict(cache: DataFrame, changed: DataFrame, members: str = "members") -> DataFrame:
    """Entries of ``cache`` that hold none of the changed ids."""
    rows = cache.select("key", F.explode(members).alias("id"))
    return cache.join(rows.join(changed.select("id").distinct(), "id", "left_semi").select("key").distinct(), "key", "left_anti")


#: Numbers of ``seq`` that make a block: the most events of one document that a task sorts.
SEQ_BLOCK = 1 << 18


def above_all_earlier(events: DataFrame, known: DataFrame | None = None, block: int = SEQ_BLOCK) -> DataFrame:
    """Events whose version is above those of all earlier ones of their document, in the order of ``seq``, and above ``known``.

    ``known`` has (document_id, version). A document's events are cut into blocks of ``seq``,
    so that one with most of the events is many groups; the greatest version of each block,
    combined before the shuffle, is carried on to the later ones. Of events of one ``seq``
    the lower version comes first. A null document_id is a document of its own; events
    without a version are never above.
    """
    rows = events.withColumn("block", F.floor(F.col("seq") / F.lit(block)))
    most = rows.groupBy("document_id", "block").agg(F.max("version").alias("most"))
    earlier = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = most.withColumn("carried", F.max("most").over(earlier)).drop("most")
    if known is not None:
        carried = carried.join(known.withColumnRenamed("version", "known"), "document_id", "left").withColumn("carried", F.greatest("carried", "known")).drop("known")
    carried = carried.withColumnsRenamed({"document_id": "d", "block": "b"})
    met = rows.join(carried, rows["document_id"].eqNullSafe(carried["d"]) & rows["block"].eqNullSafe(carried["b"])).drop("d", "b")
    before = Window.partitionBy("document_id", "block").orderBy("seq", "version").rowsBetween(Window.unboundedPreceding, -1)
    floor = F.greatest(F.max("version").over(before), F.col("carried"))  # greatest skips nulls
    rows = met.withColumn("floor", floor)
    return rows.where(F.col("version").isNotNull() & (F.col("floor").isNull() | (F.col("version") > F.col("floor")))).drop("floor", "carried", "block")


def version_guard(events: DataFrame, tenant: str | None = None) -> DataFrame:
    """Accepted events: version above all earlier ones of the document, in the order of ``seq``. Null tenants match no tenant."""
    return above_all_earlier(events if tenant is None else events.where(F.col("tenant_id") == tenant))


def latest_versions(events: DataFrame) -> DataFrame:
    """Highest version, number of deliveries and of distinct versions of each document; combined before the shuffle."""
    return events.groupBy("document_id").agg(F.max("version").alias("version"), F.count("*").alias("deliveries"), F.countDistinct("version").alias("versions"))
