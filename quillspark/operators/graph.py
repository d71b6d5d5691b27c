"""Graph operators over vertex and edge tables. Ids are compared without regard to case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import checkpoint


def dedup_entities(entities: DataFrame, order: str) -> DataFrame:
    """The first entity of each name."""
    place = F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(order))
    return entities.withColumn("r", place).where("r = 1").drop("r")


def both_ways(edges: DataFrame) -> DataFrame:
    """``(a, b)`` in lower case, each edge in both directions, without loops."""
    e = edges.select(F.lower("from_id").alias("a"), F.lower("to_id").alias("b")).where("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, most_rounds: int = 100) -> DataFrame:
    """``(id, component)``: the component is the smallest id in it. Vertices without edges are their own.

    Alternates large-star and small-star steps, so that the number of rounds grows with the
    logarithm of the size, not with the length of the longest path; every round replaces
    the edges by at most as many, whatever the degree, and is checkpointed.
    """
    e = checkpoint(both_ways(edges).where("a > b"))
    last = None
    for _ in range(most_rounds):
        # large star: every larger neighbour is tied to the least of the neighbourhood
        every = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = every.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = every.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: every smaller neighbour, and the vertex, are tied to the least of them
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        tied = e.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        e = checkpoint(tied.where("a <> b").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    rows = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    roots = rows.select(F.col("component").alias("id")).distinct().withColumn("component", F.col("id"))
    out = rows.unionByName(roots)
    if vertices is not None:
        alone = vertices.select(F.lower("id").alias("id")).distinct().join(out.select("id"), "id", "left_anti")
        out = out.unionByName(alone.withColumn("component", F.col("id")))
    return out


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``(id, hop)``: vertices within ``hops`` undirected steps of the seeds, with the least number of steps."""
    e = both_ways(edges)
    seen = seeds.select(F.lower("id").alias("id")).distinct().withColumn("hop", F.lit(0))
    frontier = seen
    for h in range(1, hops + 1):
        reached = e.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = checkpoint(reached.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h)))
        seen = seen.unionByName(frontier)
    return seen


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Add the place, from 0, of each row in the order of a distinct column, without one task for all rows.

    Rows are range-partitioned and numbered within their range; what comes before a range
    is summed over the counts of the ranges, one row for each partition.
    """
    parts = checkpoint(rows.repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    counted = parts.withColumn("within", place).join(F.broadcast(starts), "part")
    return counted.withColumn(name, (F.col("start") + F.col("within")).cast("int")).drop("part", "within", "start")


def community_texts(components: DataFrame, entities: DataFrame) -> DataFrame:
    """``(community_id, members, text)``: communities in the order of their least id, members by type and name.

    Members without an entity are left out; a community of none has no text, though it counts in the order.
    """
    order = numbered(components.select("component").distinct(), "component", "community_id")
    rows = components.join(order, "component").join(entities.select(F.lower("id").alias("id"), "type", "name"), "id")
    member = F.concat_ws(": ", "type", "name")
    parts = F.array_sort(F.collect_list(member))
    return rows.groupBy("community_id").agg(F.count("*").alias("members"), F.concat(F.lit("Members: "), F.array_join(parts, ", ")).alias("text"))


def community_blocks(components: DataFrame, entities: DataFrame, block: int = 500) -> DataFrame:
    """``(community_id, block_no, members, text)``: as community_texts, with at most ``block`` members a row.

    The blocks of a community are numbered from 0 in the order of its members by type, name
    and id, so that a community of any size never gathers in one task.
    """
    order = numbered(components.select("component").distinct(), "component", "community_id")
    rows = components.join(order, "component").join(entities.select(F.lower("id").alias("id"), "type", "name"), "id")
    rows = rows.select("community_id", F.concat_ws(": ", "type", "name").alias("member"), "id")
    placed = numbered(rows.withColumn("order", F.struct("community_id", "member", "id")), "order", "place")
    placed = checkpoint(placed.select("community_id", "member", "id", "place"))
    # one row for each community, reduced before the shuffle
    first = placed.groupBy("community_id").agg(F.min("place").alias("first"))
    rows = placed.join(first, "community_id").withColumn("block_no", F.floor((F.col("place") - F.col("first")) / block).cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "member"))), lambda x: x["member"])
    return rows.groupBy("community_id", "block_no").agg(F.count("*").alias("members"), F.concat(F.lit("Members: "), F.array_join(parts, ", ")).alias("text"))


def entity_text(type_: Column, name: Column, properties: Column | None = None) -> Column:
    """``Type: Name (k=v; ...)`` with the properties in order of their keys."""
    head = F.concat_ws(": ", type_, name)
    if properties is None:
        return head
    pairs = F.array_sort(F.transform(F.map_entries(properties), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.when(F.size(pairs) > 0, F.concat(head, F.lit(" ("), F.array_join(pairs, "; "), F.lit(")"))).otherwise(head)


def search(entities: DataFrame, edges: DataFrame, words: list[str], hops: int = 1) -> DataFrame:
    """``(id, rank, score, text)``: entities whose name holds one of the words, then what lies within ``hops`` of them.

    Seeds come first, then by distance and id; the score is 1 / rank. At most the reached entities are ranked.
    """
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower("name").contains(w.lower())
    reached = within_hops(edges, entities.where(hit), hops)
    rows = reached.join(entities.select(F.lower("id").alias("id"), entity_text(F.col("type"), F.col("name")).alias("text")), "id")
    out = numbered(rows.withColumn("order", F.struct("hop", "id")), "order", "place")
    return out.select("id", (F.col("place") + 1).alias("rank"), F.round(1.0 / (F.col("place") + 1), 6).alias("score"), "text")
