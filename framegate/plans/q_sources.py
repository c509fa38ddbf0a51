"""Queries for readers, listings, checks and sinks."""

from pyspark.sql import functions as F

from framegate.functions.keys import output_stem
from framegate.operators.filters import is_detected
from framegate.plans.registry import query
from framegate.runtime import scratch_path
from framegate.sources import readers as R


@query(
    "S1_read_jsonl",
    """SELECT 'strict' AS mode, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM documents UNION ALL SELECT 'lenient', count(*), CAST(sum(doc_id) AS BIGINT) FROM documents WHERE doc_id % 10 <> 3
UNION ALL SELECT 'absent', 0, NULL""",
)
def _(t):
    good = F.to_json(F.struct("doc_id", "source"))
    path, broken = scratch_path(t.spark, "jsonl"), scratch_path(t.spark, "jsonl")
    # A byte order mark before the first column and blank lines between rows.
    lines = t.documents.select(F.explode(F.array(F.concat(F.lit("﻿"), good), F.lit("  "))).alias("value"))
    lines.write.text(path)
    t.documents.select(F.when(F.col("doc_id") % 10 == 3, '{"doc_id": ').otherwise(good).alias("value")).write.text(broken)
    schema = "doc_id bigint, source string"
    parts = {
        "strict": R.read_jsonl(t.spark, path, schema), "lenient": R.read_jsonl(t.spark, broken, schema, "lenient"),
        "absent": R.read_jsonl(t.spark, path + "-none", schema),
    }
    counted = [df.agg(F.lit(m).alias("mode"), F.count("*").alias("n"), F.sum("doc_id").alias("ids")) for m, df in parts.items()]
    return counted[0].unionAll(counted[1]).unionAll(counted[2])


def _board_docs(t):
    """One board document per thirty orders; the items stay in order."""
    item = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("positive").alias("kind"), F.concat(F.lit("img/"), F.col("o_orderkey")).alias("image_path"),
    )
    rows = t.orders.select(
        F.floor(F.col("o_orderkey") / 30).alias("board"), F.when(F.col("o_orderstatus") == "F", "old_val").otherwise("harvest_holdout").alias("split"),
        "o_orderkey", item.alias("item"),
    )
    lists = rows.groupBy("board", "split").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "item"))).alias("l"))
    docs = lists.groupBy("board").agg(F.map_from_entries(F.collect_list(F.struct("split", F.col("l.item")))).alias("splits"))
    return docs.select("board", F.to_json(F.struct("splits")).alias("doc"))


_BOARD_SQL = """(SELECT o_orderkey, o_orderkey // 30 AS board, CASE WHEN o_orderstatus = 'F' THEN 'old_val' ELSE 'harvest_holdout' END AS split FROM orders)"""


@query(
    "S2_explode_board",
    f"""SELECT split, CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (PARTITION BY board, split ORDER BY o_orderkey) - 1 AS pos, 'img/' || o_orderkey AS image_path FROM {_BOARD_SQL}""",
)
def _(t):
    rows = R.explode_board(_board_docs(t), "doc")
    return rows.select("split", "id", F.col("pos").cast("bigint").alias("pos"), "image_path")


@query(
    "S3_normalize_summary",
    """WITH o AS (SELECT *, o_orderkey // 40 AS run FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY o_orderkey) AS rn FROM o)
SELECT run AS path, CASE WHEN run % 3 = 0 THEN rn ELSE o_orderkey END AS "index", 'img/' || o_orderkey AS image_path, CASE WHEN run % 3 = 0 THEN 'ov' WHEN o_custkey % 2 = 0 THEN 'out/' || o_orderkey ELSE '' END AS overlay_path,
  o_custkey AS pred_area, CASE WHEN run % 3 = 0 THEN 'rows' ELSE 'harvest' END AS summary_type FROM r WHERE run % 3 = 0 OR o_custkey % 7 <> 0""",
)
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("img/"), k)
    row = F.struct(name.alias("image_path"), F.lit("ov").alias("overlay_path"), c.alias("pred_area"))
    entry = F.struct(
        k.alias("source_index"), F.when(c % 7 == 0, " ").otherwise(name).alias("source_path"),
        F.when(c % 2 == 0, " Predicted").otherwise("no_prediction").alias("decision"), F.concat(F.lit("out/"), k).alias("output_path"), c.alias("mask_pixels"),
    )

    plain = F.floor(k / 40) % 3 == 0  # the older of the two document shapes

    def docs(shape, item, field, extra):
        lists = t.orders.filter(shape).groupBy(F.floor(k / 40).alias("path")).agg(F.array_sort(F.collect_list(F.struct(k, item.alias("item")))).alias("l"))
        return lists.select("path", F.to_json(F.struct(F.col("l.item").alias(field), *extra)).alias("doc"))

    extra = [F.lit("/out").alias("output_root"), F.lit("/frames").alias("frames_dir")]
    both = docs(plain, row, "rows", []).unionByName(docs(~plain, entry, "entries", extra))
    return R.normalize_summary(both, "doc", "path").select("path", "index", "image_path", "overlay_path", "pred_area", "summary_type")


@query(
    "S4_latest_run",
    """SELECT conv_id AS root, turn AS run FROM conversations WHERE length(text) % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn = 3 AND conv_id % 4 = 0 THEN 0 ELSE 1 END, length(text) DESC, turn) = 1""",
)
def _(t):
    size = F.length("text")
    runs = t.conversations.select(
        F.col("conv_id").alias("root"), F.col("turn").alias("run"), (size % 5 != 0).alias("has_summary"),
        ((F.col("turn") == 3) & (F.col("conv_id") % 4 == 0)).alias("is_harvest"), size.alias("mtime"),
    )
    return R.latest_run(runs).select("root", "run")


def text_blocks(t, span=1000):
    """The documents as text files in a new folder: one per source and ``span`` ids, written in parallel."""
    path = scratch_path(t.spark, "texts")
    rows = t.documents.select("source", F.floor(F.col("doc_id") / span).alias("block"), "doc_id", "text")
    rows = rows.repartition("source", "block").sortWithinPartitions("source", "block", "doc_id")
    rows.drop("doc_id").write.partitionBy("source", "block").text(path)
    return path


def bounded_text_files(t, rows=100_000):
    """The documents as text files of at most ``rows`` documents, many per source, written in parallel in a new folder."""
    path = scratch_path(t.spark, "texts")
    t.documents.select("source", "text").write.option("maxRecordsPerFile", rows).partitionBy("source").text(path)
    return path


def source_of(path):
    return F.regexp_extract(path, r"/source=([^/]*)/[^/]+$", 1).alias("source")


@query("S5_list_files", "SELECT source, sum(strlen(text) + 1)::BIGINT AS size FROM documents GROUP BY source")
def _(t):
    files = R.list_images(t.spark, bounded_text_files(t), suffixes=("txt",))
    return files.select(source_of("path"), "size").groupBy("source").agg(F.sum("size").alias("size"))


@query(
    "S6_first_existing",
    """WITH a AS (SELECT doc_id AS id, 0 AS root_no, 'label' AS doc FROM labels UNION ALL SELECT item_id, 1, 'bench' FROM benchmark UNION ALL SELECT id, 2, source FROM fx_annotations WHERE id % 2 = 0)
SELECT id, root_no, doc FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY root_no) = 1""",
)
def _(t):
    roots = [
        t.labels.select(F.col("doc_id").alias("id"), F.lit("label").alias("doc")),
        t.benchmark.select(F.col("item_id").alias("id"), F.lit("bench").alias("doc")),
        t.fx_annotations.filter("id % 2 = 0").select("id", F.col("source").alias("doc")),
    ]
    return R.first_existing(roots, ["id"]).select("id", "root_no", "doc")


@query("S7_history_rows", "SELECT run, CAST(epoch AS BIGINT) AS epoch, val_dice, CAST(NULL AS DOUBLE) AS hard_val_dice FROM fx_history")
def _(t):
    item = F.struct(F.col("epoch"), F.col("val_dice"))
    arrays = t.fx_history.filter("run < 'm'").groupBy("run").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("doc"))
    lines = t.fx_history.filter("run >= 'm'").select("run", F.to_json(item).alias("doc"))
    return R.history_rows(arrays.unionByName(lines), "doc", "run", ["val_dice", "hard_val_dice"])


@query("S8_append_rows", "SELECT id, source FROM fx_annotations UNION ALL SELECT id, source FROM fx_annotations WHERE id % 3 = 0")
def _(t):
    path = scratch_path(t.spark, "append")
    rows = t.fx_annotations.select("id", "source")
    R.append_rows(rows, path)
    R.append_rows(rows.filter("id % 3 = 0"), path)
    return R.read_jsonl(t.spark, path, "id bigint, source string")


@query(
    "S9_write_manifest",
    """SELECT 'val' AS name, '{"num_images":' || count(*) || ',"positive_count":' || count(*) FILTER (WHERE mask_area > 0) || ',"seed":42}' AS meta, CAST(sum(id) AS BIGINT) AS ids FROM fx_annotations""",
)
def _(t):
    path = scratch_path(t.spark, "manifest")
    meta = {"positive_count": F.count_if(F.col("mask_area") > 0), "seed": F.lit(42)}
    R.write_manifest(t.fx_annotations.select("id", "source_key", "mask_area"), path, "val", meta)
    images = t.spark.read.schema("id bigint").json(f"{path}/images").agg(F.sum("id").alias("ids"))
    return t.spark.read.schema("name string, meta string").json(f"{path}/meta").crossJoin(images)  # one row each


_ROUTED_SQL = """SELECT frame_index, CASE WHEN diff_score >= 40 AND frame_index % 50 >= 12 THEN 'predicted' ELSE 'no_prediction' END AS decision,
  'out/' || CASE WHEN diff_score >= 40 AND frame_index % 50 >= 12 THEN 'Predicted' ELSE 'No_Prediction' END || '/video_' || video_id || '__clip_f' || lpad(CAST(frame_index AS VARCHAR), 8, '0') || '.png' AS output_path,
  CASE WHEN diff_score >= 40 AND frame_index % 50 >= 12 THEN 'out/Masks_Predicted/video_' || video_id || '__clip_f' || lpad(CAST(frame_index AS VARCHAR), 8, '0') || '.png' END AS mask_output_path FROM fx_frames"""


def routed_frames(frames):
    detected = is_detected(F.col("diff_score"), F.col("frame_index") % 50, 40.0, 12)
    return R.routed(frames, detected, output_stem(F.col("path"), "C:/frames"), F.lit(".PNG"), "out")


@query("S10_routed_sink", _ROUTED_SQL)
def _(t):
    path = scratch_path(t.spark, "routed")
    R.write_routed(routed_frames(t.fx_frames).select("frame_index", "decision", "output_path", "mask_output_path"), path)
    return t.spark.read.parquet(path).select("frame_index", "decision", "output_path", "mask_output_path")


@query(
    "S11_verify_checksums",
    """SELECT 'doc' || doc_id AS path, CASE WHEN doc_id % 17 = 0 THEN 'missing' ELSE 'mismatch' END AS problem FROM documents WHERE doc_id % 17 = 0 OR doc_id % 13 = 0 OR doc_id % 11 = 0""",
)
def _(t):
    name = F.concat(F.lit("doc"), F.col("doc_id"))
    files = t.documents.filter("doc_id % 17 <> 0").select(name.alias("path"), F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    registry = t.documents.select(
        name.alias("path"), (F.octet_length("text") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0)).alias("bytes"),
        F.upper(F.sha2(F.concat("text", F.when(F.col("doc_id") % 11 == 0, "x").otherwise("")), 256)).alias("sha256"),
    )
    return R.verify_checksums(registry, files)


@query(
    "S11_file_checksums",
    """WITH b AS (SELECT source, doc_id // 1000 AS block, sum(strlen(text) + 1)::BIGINT AS bytes, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY ALL)
SELECT source, sum(bytes)::BIGINT AS bytes, count(*) AS blocks, sha256(string_agg(digest, '' ORDER BY block)) AS sha256 FROM b GROUP BY source""",
)
def _(t):
    files = R.file_checksums(t.spark, text_blocks(t))
    block = F.regexp_extract("path", r"/block=(-?[0-9]+)/[^/]+$", 1).cast("long").alias("block")
    source = F.regexp_extract("path", r"/source=([^/]*)/block=[^/]*/[^/]+$", 1).alias("source")
    return R.tree_checksums(files.select(source, block, "bytes", "sha256"), ["source"], "block")


@query(
    "S12_dependency_check",
    """SELECT o_orderkey AS id, 'C:/m/' || o_orderkey || '.PT' AS path, 'missing_or_absolute' AS problem FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT o_orderkey, 'm/' || o_custkey || '.pth', 'missing_or_absolute' FROM orders WHERE o_custkey % 5 = 0
UNION ALL SELECT o_orderkey, 'a/../../x.pt', 'outside' FROM orders WHERE o_orderkey % 21 = 0""",
)
def _(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    deep = F.struct(F.concat(F.lit("m/"), c, F.lit(".pth")).alias("checkpoint"), F.lit("note.txt").alias("note"))
    paths = F.array(F.when(k % 9 == 0, F.concat(F.lit("C:/m/"), k, F.lit(".PT"))), F.when(k % 21 == 0, F.lit("a/../../x.pt")))
    docs = t.orders.select(k.alias("id"), F.to_json(F.struct(F.array(F.struct(deep.alias("stage"))).alias("stages"), F.array_compact(paths).alias("paths"))).alias("doc"))
    files = t.orders.filter(c % 5 != 0).select(F.concat(F.lit("m/"), c, F.lit(".pth")).alias("path")).unionByName(
        t.region.select(F.lit("a/../../x.pt").alias("path"))
    )
    return R.broken_dependencies(docs, "id", "doc", files)
