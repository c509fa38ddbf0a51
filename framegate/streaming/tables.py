"""Tables that streams keep up to date batch by batch, so that a batch reads and writes a bounded part of them.

Rows lie in buckets by the hash of their key. A batch rewrites the buckets it touches into a folder of its own, and a small
commit file then says for every bucket which folder holds it. Readers follow the newest commit, so a batch that failed half
way is not seen, and a repeated one starts from the commit before it and writes the same again. Folders and commits that
neither of the last two commits needs are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framegate.runtime import child_folders, delete_folder

BUCKETS = 32


class BucketTable:
    """The newest row of every key below ``path``; ``keys`` are the key columns."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def commits(self) -> list[int]:
        """Numbers of the batches that were committed and are still kept, in order."""
        return sorted(int(name.removeprefix("batch=")) for name in child_folders(self.spark, f"{self.path}/commits"))

    def committed(self, before: int | None = None) -> tuple[int, dict[int, int], str | None]:
        """The newest commit (of a batch ``before`` the given one): its batch, the folder of every bucket, and its note."""
        numbers = [n for n in self.commits() if before is None or n < before]
        if not numbers:
            return -1, {}, None
        schema = "bucket int, folder int, note string"
        found = self.spark.read.schema(schema).parquet(f"{self.path}/commits/batch={numbers[-1]}").collect()  # a row a bucket
        return numbers[-1], {r["bucket"]: r["folder"] for r in found if r["folder"] is not None}, next((r["note"] for r in found), None)

    def rows(self, folders: dict[int, int], buckets: set[int] | None = None) -> DataFrame | None:
        """The rows of a commit, of some buckets only if given; None if there are none."""
        wanted = [(b, f) for b, f in folders.items() if buckets is None or b in buckets]
        paths = [f"{self.path}/data/folder={f}/bucket__={b}" for b, f in sorted(wanted)]
        return self.spark.read.parquet(*paths) if paths else None

    def touched(self, rows: DataFrame) -> set[int]:
        return {r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()}  # at most a row a bucket

    def merge(self, rows: DataFrame, batch: int, note: str | None = None) -> None:
        """Put ``rows``, one per key, in place of those with their keys, as batch number ``batch``."""
        previous, folders, _ = self.committed(batch)
        hit = self.touched(rows)
        old = self.rows(folders, hit)
        merged = rows if old is None else rows.unionByName(old.join(rows.select(*self.keys), self.keys, "left_anti"))
        if hit:
            placed = merged.withColumn("bucket__", self.bucket()).repartition("bucket__")
            placed.write.mode("overwrite").partitionBy("bucket__").parquet(f"{self.path}/data/folder={batch}")
        now = {**folders, **{b: batch for b in hit}}
        entries = [(b, now.get(b), note) for b in range(self.buckets)]
        commit = self.spark.createDataFrame(entries, "bucket int, folder int, note string").coalesce(1)
        commit.write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")
        self._clean(previous, {*now.items(), *folders.items()})

    def _clean(self, previous: int, needed: set[tuple[int, int]]) -> None:
        """Delete what neither this commit nor the one before (from which a repeat would start) points to."""
        for number in self.commits():
            if number < previous:
                delete_folder(self.spark, f"{self.path}/commits/batch={number}")
        for name in child_folders(self.spark, f"{self.path}/data"):
            folder = f"{self.path}/data/{name}"
            for bucket in child_folders(self.spark, folder):
                if (int(bucket.removeprefix("bucket__=")), int(name.removeprefix("folder="))) not in needed:
                    delete_folder(self.spark, f"{folder}/{bucket}")
            if not child_folders(self.spark, folder):
                delete_folder(self.spark, folder)


class DoneKeys:
    """Which keys a sink's runs have written: an index per run, and the batches a run wrote after its last commit."""

    def __init__(self, spark: SparkSession, path: str, tables: list[str], run: str, keys: list[str]):
        self.spark, self.path, self.tables, self.run, self.keys = spark, path, tables, run, keys
        self.own = BucketTable(spark, f"{path}/run={run}", keys)

    def _others(self) -> list[str]:
        known = {*child_folders(self.spark, self.path)}
        for table in self.tables:
            known |= {n for n in child_folders(self.spark, table) if n.startswith("run=")}
        return sorted(known - {f"run={self.run}"})

    def fresh(self, batch: DataFrame, number: int) -> tuple[DataFrame, str | None]:
        """The rows of ``batch`` whose keys no other run and no earlier batch of this run has written, and the largest
        note of those. Only the buckets that the batch touches are read."""
        hit = self.own.touched(batch)
        _, folders, note = self.own.committed(number)
        done, notes = [self.own.rows(folders, hit)], [note]
        for run in self._others():
            index = BucketTable(self.spark, f"{self.path}/{run}", self.keys)
            last, folders, note = index.committed()
            done.append(index.rows(folders, hit))
            notes.append(note)
            for table in self.tables:
                batches = [n for n in child_folders(self.spark, f"{table}/{run}") if int(n.removeprefix("batch=")) > last]
                if batches:
                    done.append(self.spark.read.parquet(*[f"{table}/{run}/{n}" for n in batches]))
        for rows in done:
            if rows is not None:
                batch = batch.join(rows.select(*self.keys).distinct(), self.keys, "left_anti")
        return batch, max((n for n in notes if n is not None), default=None)

    def commit(self, rows: DataFrame, number: int, note: str | None = None) -> None:
        self.own.merge(rows.select(*self.keys).distinct(), number, note)
