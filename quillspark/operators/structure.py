"""Heading trees of markdown documents and their navigation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.operators.pages import split_lines

#: Fixed value: markdown has six levels of headings, so a path has at most six steps.
LEVELS = 6
HEADING = r"^(#{1,6})\s+(.*)$"


def heading_tree(documents: DataFrame) -> DataFrame:
    """``(document_id, node_no, level, title, path, parent_no, body, line_no)`` of every heading.

    The parent is the last heading before of a smaller level: for each level the last
    heading is carried down by a window, and forgotten where a heading of a smaller level
    comes later. The body is what follows up to the next heading.
    """
    order = Window.partitionBy("document_id").orderBy("line_no")
    rows = split_lines(documents)
    mark = F.regexp_extract("line", HEADING, 1)
    rows = rows.withColumns({"level": F.when(mark != "", F.length(mark)), "title": F.when(mark != "", X.trim(F.regexp_extract("line", HEADING, 2)))})
    rows = rows.withColumn("node_no", F.sum(F.col("level").isNotNull().cast("int")).over(order).cast("int"))
    body = F.array_sort(F.collect_list(F.when(F.col("level").isNull(), F.struct("line_no", "line"))))
    nodes = rows.where("node_no > 0").groupBy("document_id", "node_no").agg(
        F.max("level").alias("level"), F.max("title").alias("title"), F.min("line_no").alias("line_no"),
        X.trim(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("body"),
    )
    before = Window.partitionBy("document_id").orderBy("node_no").rowsBetween(Window.unboundedPreceding, -1)
    last = {
        f"at{k}": F.last(F.when(F.col("level") == k, F.struct("node_no", "title")), ignorenulls=True).over(before) for k in range(1, LEVELS)
    }
    nodes = nodes.withColumns(last)
    # of the smaller levels, those that no later heading of a smaller or equal level has closed
    steps = []
    for k in range(1, LEVELS):
        later = [F.col(f"at{j}.node_no") for j in range(1, k)]
        is_open = (F.col("level") > k) & F.col(f"at{k}").isNotNull()
        for c in later:
            is_open = is_open & (c.isNull() | (c < F.col(f"at{k}.node_no")))
        steps.append(F.when(is_open, F.col(f"at{k}")))
    ancestors = F.filter(F.array(*steps), lambda x: x.isNotNull())
    path = F.array_join(F.concat(F.transform(ancestors, lambda x: x["title"]), F.array("title")), " > ")
    parent = F.when(F.size(ancestors) > 0, F.element_at(ancestors, -1)["node_no"])
    return nodes.select("document_id", "node_no", "level", "title", path.alias("path"), parent.alias("parent_no"), "body", "line_no")


def node_ids(tree: DataFrame) -> DataFrame:
    """Add ``node_id``: formal id or slug of the path, with ``#n`` for the n-th of the same id in a document."""
    plain = F.coalesce(X.formal_id(F.col("title")), X.slug(F.col("path")))
    same = F.row_number().over(Window.partitionBy("document_id", plain).orderBy("node_no"))
    return tree.withColumn("node_id", F.when(same == 1, plain).otherwise(F.concat_ws("#", plain, same.cast("string"))))


def cross_references(tree: DataFrame) -> DataFrame:
    """``(document_id, node_no, target_no)``: formal references in the body to headings of the same document, without self."""
    targets = tree.select("document_id", X.formal_id(F.col("title")).alias("ref"), F.col("node_no").alias("target_no")).where("ref is not null")
    first = targets.groupBy("document_id", "ref").agg(F.min("target_no").alias("target_no"))
    refs = tree.select("document_id", "node_no", F.explode(X.references(F.concat_ws("\n", "title", "body"))).alias("ref"))
    return refs.join(first, ["document_id", "ref"]).where("node_no <> target_no").select("document_id", "node_no", "target_no").distinct()


def ancestors(tree: DataFrame) -> DataFrame:
    """``(document_id, node_no, ancestor_no, distance)``: at most five joins, as a path has at most six steps."""
    parents = tree.where("parent_no is not null").select("document_id", "node_no", F.col("parent_no").alias("ancestor_no"))
    out = step = parents.withColumn("distance", F.lit(1))
    up = parents.select("document_id", F.col("node_no").alias("ancestor_no"), F.col("ancestor_no").alias("next"))
    for d in range(2, LEVELS):
        step = step.join(up, ["document_id", "ancestor_no"]).select("document_id", "node_no", F.col("next").alias("ancestor_no"), F.lit(d).alias("distance"))
        out = out.unionByName(step)
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """``(document_id, node_no, descendant_no, depth)``, breadth first by depth then number, without self."""
    rows = ancestors(tree)
    return rows.select("document_id", F.col("ancestor_no").alias("node_no"), F.col("node_no").alias("descendant_no"), F.col("distance").alias("depth"))


def siblings(tree: DataFrame) -> DataFrame:
    """``(document_id, node_no, siblings)``: numbers of the other children of the parent, in document order."""
    family = F.array_sort(F.collect_list("node_no").over(Window.partitionBy("document_id", "parent_no")))
    return tree.select("document_id", "node_no", F.array_except(family, F.array("node_no")).alias("siblings"))


def with_references(tree: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``(document_id, node_no, hop)``: nodes reached over cross references in at most ``depth`` steps."""
    refs = cross_references(tree)
    seen = frontier = starts.select("document_id", "node_no").distinct().withColumn("hop", F.lit(0))
    for h in range(1, depth + 1):
        step = frontier.join(refs, ["document_id", "node_no"]).select("document_id", F.col("target_no").alias("node_no")).distinct()
        frontier = step.join(seen.select("document_id", "node_no"), ["document_id", "node_no"], "left_anti").withColumn("hop", F.lit(h))
        seen = seen.unionByName(frontier)
    return seen


def picked_nodes(tree: DataFrame, picks: list[tuple[str, int]], depth: int = 1) -> DataFrame:
    """``(document_id, node_no, rank, score, title, body)`` of the nodes a model picked, in its order, then of what they refer to.

    ``picks`` are (document_id, node_no) of one request; the score is 1 / rank. Unknown picks are passed over.
    """
    spark = tree.sparkSession
    asked = spark.createDataFrame([(d, n, i) for i, (d, n) in enumerate(dict.fromkeys(picks))], "document_id string, node_no int, pick int")
    near = with_references(tree, asked, depth).join(asked, ["document_id", "node_no"], "left")
    rows = tree.select("document_id", "node_no", "title", "body").join(F.broadcast(near), ["document_id", "node_no"])
    order = Window.orderBy("hop", "pick", "document_id", "node_no")  # the nodes of one request
    rows = rows.withColumn("rank", F.row_number().over(order))
    return rows.select("document_id", "node_no", "rank", F.round(1.0 / F.col("rank"), 6).alias("score"), "title", "body")
