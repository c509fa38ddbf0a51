"""Readers for label files, boards, summaries, histories and file listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from framegate.operators.documents import flatten_leaves
from framegate.operators.ranking import keep_first, top_per_key

# Image file suffixes and the splits of a board.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp")
BOARD_SPLITS = ("old_val", "old_hard_val", "harvest_holdout", "rejected_negatives", "flat_negatives")
BOARD_ITEM = "array<struct<id:string,kind:string,image_path:string,mask_path:string,source_image_path:string,group_key:string,source:string>>"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Works for every file system Spark can read."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "strict") -> DataFrame:
    """JSON lines. ``strict`` fails on a bad line, ``lenient`` drops it; a missing path gives no rows.

    Blank lines are skipped and a byte order mark is removed. Lines are split across tasks, so a strict failure
    names the line text.
    """
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not path_exists(spark, path):
        return spark.createDataFrame([], typed)
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).filter(F.trim("value") != "")
    corrupt = T.StructType([*typed.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("value", F.from_json("value", corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = F.col("r._bad").isNull() & F.col("r").isNotNull()
    if mode == "lenient":
        kept = parsed.filter(good)
    else:
        problem = F.raise_error(F.concat(F.lit("bad JSON line: "), F.substring("value", 1, 200))).cast("boolean")
        kept = parsed.filter(F.when(good, F.lit(True)).otherwise(problem))
    return kept.select(*[F.col(f"r.{f.name}").alias(f.name) for f in typed.fields])


def explode_board(docs: DataFrame, doc: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """Long rows of a board document with their position; a wanted split that is not there is an error."""
    splits = docs.select(F.from_json(doc, f"splits map<string,{BOARD_ITEM}>")["splits"].alias("splits"))
    if wanted:
        for name in wanted:
            problem = F.raise_error(f"unknown split: {name}").cast("boolean")
            splits = splits.filter(F.when(F.map_contains_key("splits", name), F.lit(True)).otherwise(problem))
        splits = splits.withColumn("splits", F.map_filter("splits", lambda k, _: k.isin(*wanted)))
    rows = splits.select(F.explode("splits").alias("split", "items"))
    return rows.select("split", F.posexplode("items").alias("pos", "item")).select("split", "pos", "item.*")


def normalize_summary(docs: DataFrame, doc: str, path: str) -> DataFrame:
    """Both report layouts as one row per image: plain ``rows``, or the ``entries`` of a harvest run."""
    row = "array<struct<index:bigint,image_path:string,overlay_path:string,mask_path:string,pred_area:bigint,score:double>>"
    entry = (
        "array<struct<source_index:bigint,source_path:string,decision:string,output_path:string,mask_output_path:string,"
        "mask_pixels:bigint,score:double>>"
    )
    parsed = docs.select(path, F.from_json(doc, f"rows {row}, entries {entry}, output_root string, frames_dir string").alias("d"))
    plain = parsed.filter("d.rows IS NOT NULL").select(path, F.posexplode("d.rows").alias("_p", "r")).select(
        path, F.coalesce("r.index", F.col("_p") + 1).alias("index"), "r.image_path", F.coalesce("r.overlay_path", F.lit("")).alias("overlay_path"),
        F.coalesce("r.mask_path", F.lit("")).alias("mask_path"), "r.pred_area", "r.score", F.lit("rows").alias("summary_type"),
    )
    harvest = parsed.filter("d.rows IS NULL AND d.entries IS NOT NULL AND d.output_root IS NOT NULL AND d.frames_dir IS NOT NULL")
    named = harvest.select(path, F.filter("d.entries", lambda e: F.trim(F.coalesce(e["source_path"], F.lit(""))) != "").alias("entries"))
    e = named.select(path, F.posexplode("entries").alias("_p", "e"))
    decision = F.lower(F.trim(F.coalesce("e.decision", F.lit(""))))
    output = F.trim(F.coalesce("e.output_path", F.lit("")))
    long = e.select(
        path, F.coalesce("e.source_index", F.col("_p") + 1).alias("index"), F.trim("e.source_path").alias("image_path"),
        F.when(decision == "predicted", output).otherwise("").alias("overlay_path"), F.trim(F.coalesce("e.mask_output_path", F.lit(""))).alias("mask_path"),
        F.coalesce("e.mask_pixels", F.lit(0)).alias("pred_area"), "e.score", F.lit("harvest").alias("summary_type"),
    )
    return plain.unionByName(long)


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run per root that has a summary; a harvest summary of the root itself comes first.

    ``runs`` has ``(root, run, has_summary, is_harvest, mtime)``.
    """
    usable = runs.filter("has_summary")
    return top_per_key(usable, ["root"], [F.desc("is_harvest"), F.desc("mtime"), "run"])


def list_images(spark: SparkSession, root: str, recursive: bool = True, suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Image files below a root, once each: path, size and change time. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter(suffix.isin(*suffixes)).dropDuplicates(["path"])


def first_existing(roots: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Per item the document of the first root that has it; ``root_no`` tells which."""
    merged = roots[0].withColumn("root_no", F.lit(0))
    for number, root in enumerate(roots[1:], 1):
        merged = merged.unionByName(root.withColumn("root_no", F.lit(number)))
    return keep_first(merged, keys, ["root_no"])


def history_rows(docs: DataFrame, doc: str, run: str, metrics: Sequence[str]) -> DataFrame:
    """Epoch rows of training histories given as one JSON array per run, or as one JSON object per line."""
    fields = ", ".join(f"{m}: double" for m in metrics)
    item = f"struct<epoch: bigint, {fields}>"
    array = F.from_json(doc, f"array<{item}>")
    single = F.array(F.from_json(doc, f"epoch bigint, {', '.join(f'{m} double' for m in metrics)}"))
    is_array = F.ltrim(doc).startswith("[")
    rows = docs.select(run, F.explode(F.when(is_array, array).otherwise(single)).alias("e"))
    return rows.select(run, "e.*").filter("epoch IS NOT NULL")


def verify_checksums(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Registered files that are missing or differ in size or SHA-256. Both sides have ``(path, bytes, sha256)``."""
    found = files.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    joined = registry.join(found, "path", "left")
    problem = F.when(F.col("_h").isNull(), "missing").when((F.col("_b") != F.col("bytes")) | (F.lower("_h") != F.lower("sha256")), "mismatch")
    return joined.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def file_checksums(spark: SparkSession, root: str) -> DataFrame:
    """Size and SHA-256 of the files below a root, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_checksums(files: DataFrame, keys: Sequence[str], block: str) -> DataFrame:
    """Size, number of blocks and digest of what is kept as many bounded files: ``files`` has ``(keys, block, bytes,
    sha256)``, and the digest is the SHA-256 of the blocks' digests in block order. Files are hashed where they lie, so no
    task reads more than a block; a digest of 64 characters per block is all that meets."""
    digests = F.transform(F.array_sort(F.collect_list(F.struct(block, "sha256"))), lambda b: b["sha256"])
    return files.groupBy(*keys).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("blocks"), F.sha2(F.array_join(digests, ""), 256).alias("sha256")
    )


def broken_dependencies(docs: DataFrame, id_col: str, doc: str, files: DataFrame) -> DataFrame:
    """Checkpoint paths named anywhere in a document that are absolute, leave the package or do not exist."""
    value = F.col("value")
    named = flatten_leaves(docs, id_col, doc).filter(F.lower("value").endswith(".pt") | F.lower("value").endswith(".pth"))
    named = named.select(id_col, value.alias("path")).distinct()
    known = files.select("path").distinct().withColumn("_f", F.lit(1))
    joined = named.join(known, "path", "left")
    absolute = F.col("path").startswith("/") | F.col("path").contains(":")
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))

    def enter(at, part):
        step = F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        depth = at["depth"] + step
        return F.struct(depth.alias("depth"), (at["out"] | (depth < 0)).alias("out"))

    outside = F.aggregate(F.split("path", "/"), start, enter)["out"]
    problem = F.when(absolute | F.col("_f").isNull(), "missing_or_absolute").when(outside, "outside")
    return joined.select(id_col, "path", problem.alias("problem")).filter("problem IS NOT NULL")


def append_rows(rows: DataFrame, path: str, fmt: str = "json") -> None:
    rows.write.mode("append").format(fmt).save(path)


def manifest_meta(images: DataFrame, name: str, meta: dict[str, Column]) -> DataFrame:
    """The head of a manifest: counts and settings in one row. The images themselves are written as rows."""
    fields = F.struct(F.count("*").alias("num_images"), *[c.alias(n) for n, c in meta.items()])
    return images.agg(F.lit(name).alias("name"), F.to_json(fields).alias("meta"))


def write_manifest(images: DataFrame, path: str, name: str, meta: dict[str, Column]) -> None:
    """``images/`` as JSON lines in many files, ``meta/`` as one row."""
    images.write.mode("overwrite").json(f"{path}/images")
    manifest_meta(images, name, meta).write.mode("overwrite").json(f"{path}/meta")


def routed(rows: DataFrame, detected: Column, stem: Column, suffix: Column, root: str) -> DataFrame:
    """Decision and target paths of harvested frames: overlay and mask, or the unchanged frame."""
    hit = F.coalesce(detected, F.lit(False))

    def target(folder, ext):
        return F.concat(F.lit(f"{root.rstrip('/')}/{folder}/"), stem, ext)

    return rows.withColumns(
        {
            "decision": F.when(hit, "predicted").otherwise("no_prediction"),
            "output_path": F.when(hit, target("Predicted", F.lit(".png"))).otherwise(target("No_Prediction", F.lower(suffix))),
            "mask_output_path": F.when(hit, target("Masks_Predicted", F.lit(".png"))),
        }
    )


def write_routed(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("decision").parquet(path)
