"""JSON documents of open depth as rows: VARIANT values are exploded level by level until no container is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from framegate.functions.keys import SKIPPED_DOC_KEYS
from framegate.runtime import stage

#: Longest list whose entries count as numbers of a document.
MAX_ITEMS = 6


def _is(kind: str) -> Column:
    return F.col("kind").startswith(kind)


def exploded(df: DataFrame, id_col: str, doc: str, skipped: tuple[str, ...] = (), max_items: int | None = None) -> DataFrame:
    """``(id, name, kind, value, listed)``: every node of the documents that is not gone into, with its dotted name.

    ``kind`` is the node's type as ``schema_of_variant`` names it and ``listed`` says that it stands in a list. Fields named
    in ``skipped`` are left out. With ``max_items``, lists that are longer, and containers in lists, stay closed; otherwise
    only empty containers do. A null document has no nodes, a malformed one is an error. Every level is written before it
    is exploded, so there are as many jobs as levels, and no document is parsed twice.
    """
    spark = df.sparkSession

    def judged(nodes: DataFrame) -> DataFrame:
        """The nodes with their kind and whether they are gone into; lists are measured once, objects not at all."""
        size = F.when(_is("ARRAY"), F.json_array_length(F.to_json("value")))
        full = (F.col("kind") != "OBJECT<>") & (_is("OBJECT") | F.coalesce(size > 0, F.lit(False)))
        if max_items is not None:
            full = full & ~F.col("listed") & F.coalesce(size <= max_items, F.lit(True))
        return nodes.withColumn("kind", F.schema_of_variant("value")).withColumn("full", full)

    def children(nodes: DataFrame) -> DataFrame:
        """What the open nodes hold; the others stand for themselves."""
        held = nodes.select(id_col, F.col("name").alias("_name"), F.col("value").alias("_whole"), F.when(F.col("full"), F.col("value")).alias("_open"))
        found = held.lateralJoin(spark.tvf.variant_explode_outer(F.col("_open").outer()))
        found = found.filter(F.col("key").isNull() | ~F.col("key").isin(*skipped)) if skipped else found
        step = F.coalesce("key", F.col("pos").cast("string"))
        name = F.when(step.isNull() | (F.col("_name") == ""), F.coalesce(step, "_name")).otherwise(F.concat_ws(".", "_name", step))
        value, listed = F.coalesce("value", "_whole"), F.col("key").isNull() & F.col("pos").isNotNull()
        return stage(judged(found.select(id_col, name.alias("name"), value.alias("value"), listed.alias("listed"))), "level")

    texts, cores = df.select(id_col, doc), spark.sparkContext.defaultParallelism
    if texts.rdd.getNumPartitions() < cores:
        texts = texts.repartition(cores)  # a few files would leave every level to a few tasks
    root = texts.select(id_col, F.lit("").alias("name"), F.parse_json(doc).alias("value"), F.lit(False).alias("listed"))
    levels = [children(judged(root.filter("value IS NOT NULL")))]
    while not (inner := levels[-1].filter("full")).isEmpty():
        levels.append(children(inner))
    closed = [found.filter("NOT full").select(id_col, "name", "kind", "value", "listed") for found in levels]
    return reduce(DataFrame.unionByName, closed)


def flatten_numeric(df: DataFrame, id_col: str, doc: str, max_items: int = MAX_ITEMS) -> DataFrame:
    """Numbers of a JSON document as ``(id, name, value)`` with dotted names.

    Masks, booleans, texts and lists longer than ``max_items`` are left out (``long_lists`` counts those).
    """
    nodes = exploded(df, id_col, doc, SKIPPED_DOC_KEYS, max_items)
    number = _is("BIGINT") | _is("DECIMAL") | _is("DOUBLE") | _is("FLOAT")
    return nodes.filter(number).select(id_col, "name", F.try_variant_get("value", "$", "double").alias("value"))


def long_lists(df: DataFrame, id_col: str, doc: str, max_items: int = MAX_ITEMS) -> DataFrame:
    """``(id, name, entries)`` of the lists that ``flatten_numeric`` leaves out for their length."""
    nodes = exploded(df, id_col, doc, SKIPPED_DOC_KEYS, max_items)
    size = F.json_array_length(F.to_json("value"))
    return nodes.filter(_is("ARRAY") & ~F.col("listed") & (size > max_items)).select(id_col, "name", size.alias("entries"))


def flatten_leaves(df: DataFrame, id_col: str, doc: str) -> DataFrame:
    """Every leaf of a JSON document as ``(id, name, value)`` with its text; an empty object or list is a leaf."""
    nodes = exploded(df, id_col, doc)
    text = F.when(_is("STRING"), F.try_variant_get("value", "$", "string"))
    text = text.when(_is("DECIMAL") | _is("DOUBLE"), F.try_variant_get("value", "$", "double").cast("string"))
    return nodes.select(id_col, "name", text.otherwise(F.to_json("value")).alias("value"))
