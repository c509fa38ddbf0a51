"""Document fingerprints as threshold-scaled sketches.

A sketch keeps every hash of a text's word shingles below a fixed fraction of the hash range. Whether a shingle is kept
does not depend on the text, so sketches of parts merge into that of the whole, and the share of one sketch that another
holds estimates containment even between a note and a book. A text whose hashes all lie above keeps its smallest one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from framegate.llm.common import bounded_batches, map_batches, order_id, ship, text_or_empty

WORDS, FRACTION = 5, 1 / 8
#: Ranges of documents per shuffle task, and keys of the sample that bounds them.
RANGES_PER_TASK, SAMPLE_PER_RANGE = 4, 32
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """A hash per shingle of consecutive words (ASCII letters in lower case); a shorter text is one shingle."""
    tokens = text.encode().lower().split()
    values = np.frombuffer(b"".join(map(xxhash.xxh64_digest, tokens)), ">u8").astype(np.uint64)
    width = min(words, len(values))
    n = len(values) - width + 1 if width else 0
    found = np.full(n, width, np.uint64)
    for i in range(width):
        found = found * MULTIPLIER + values[i : i + n]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(29)
    found *= np.uint64(0x94D049BB133111EB)
    return found ^ (found >> np.uint64(32))


def sketch(text: str, words: int = WORDS, fraction: float = FRACTION) -> np.ndarray:
    """The distinct kept hashes in ascending order; none only for a text without words."""
    hashes = shingle_hashes(text, words)
    kept = hashes[hashes < np.uint64(int(fraction * 2**64))]
    return np.unique(kept) if len(kept) else hashes.min(keepdims=True) if len(hashes) else hashes


def merge(*sketches: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of texts taken together (of their shingles; a shingle across the seam is new)."""
    every = np.unique(np.concatenate(sketches))
    kept = every[every < np.uint64(int(fraction * 2**64))]
    return kept if len(kept) else every[:1]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of either that both have; two texts without words are alike."""
    both = shared(a, b)
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has; nothing is contained wholly."""
    return shared(a, b) / len(a) if len(a) else 1.0


def below(found: np.ndarray, fraction: float = FRACTION) -> bool:
    """Whether a sketch holds what lies below the threshold; not if it fell back to its smallest hash."""
    return not len(found) or bool(found[0] < np.uint64(int(fraction * 2**64)))


def as_text(found: np.ndarray) -> str:
    """16 hex digits per hash."""
    return found.astype(">u8").tobytes().hex()


def sketch_documents(docs: DataFrame, words: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """doc_id and ``fingerprint`` of every row: null texts are empty and have an empty one; equal texts have equal ones.
    Repeated rows and null ids keep their rows; other columns are left out; an empty table gives no rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = pa.array([as_text(sketch(t, words, fraction)) for t in batch.column(1).to_pylist()], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty())
    return map_batches(rows, run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its later half replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(text: str, own: np.ndarray, following: str, nxt: np.ndarray) -> tuple:
    new = edited(text, following)
    other = sketch(new)
    small, large = sorted((own, other), key=len)
    near = likeness(own, other), likeness(own, nxt), containment(small, large) if below(small) else None
    return len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(own), as_text(other), *near


COLUMNS = [
    ("n_chars", "long", pa.int64()), ("edited_sha256", "string", pa.string()), ("fingerprint", "string", pa.string()),
    ("edited_fingerprint", "string", pa.string()), ("near_edited", "double", pa.float64()),
    ("near_next", "double", pa.float64()), ("contained", "double", pa.float64()),
]


def sort_keys(ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """(id, text hash) pairs as 16 bytes each, in the same order."""
    flipped = np.stack([ids, hashes], 1).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return np.frombuffer(flipped.astype(">u8").tobytes(), "S16")


def _bounds(docs: DataFrame, keys: DataFrame) -> np.ndarray:
    """Lower bounds of ranges of about equal size, from a sample of the keys ``(id, th)`` whose size is bounded by the
    number of tasks."""
    ranges = RANGES_PER_TASK * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, docs.count() // (ranges * SAMPLE_PER_RANGE))
    chosen = keys.where(F.pmod(F.xxhash64("id", "th"), F.lit(every)) == 0).distinct().collect()
    sample = sorted((r["id"], r["th"]) for r in chosen)
    bounds = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    pairs = np.array(bounds, np.int64).reshape(-1, 2)
    return sort_keys(pairs[:, 0], pairs[:, 1])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Every document's sketch beside those of its edited text and of the next document by ascending doc_id.

    Documents are dealt into ranges of (id, text hash), whose bounds come from a sample; the first document of each range
    also goes to the range before, and the very first to the last. So tasks stream sorted ranges with one row of
    look-ahead, after one shuffle. Only bounds and firsts, a few numbers per range, pass the driver. Null texts are empty;
    null ids come last; rows with one id are ordered by a hash of the text and follow each other. ``contained`` is the
    containment of the smaller sketch in the larger one, null if the smaller one is a text's smallest hash only, which
    lies above the threshold and so in no larger sketch. Other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), order_id().alias("id"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    bounds = ship(spark, _bounds(docs, rows.select("id", "th")))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds(), sort_keys(ids.to_numpy(), hashes.to_numpy()), "right"))

    rows = rows.withColumn("part", range_of("id", "th"))
    firsts = rows.groupBy("part").agg(F.min(F.struct("id", "th")).alias("k")).orderBy("part").collect()
    sent = [(r["k"]["id"], r["k"]["th"], firsts[i - 1]["part"]) for i, r in enumerate(firsts)]
    before = spark.createDataFrame(sent, "id long, th long, before int")
    places = F.array(
        F.struct(F.col("part").alias("to"), F.lit(0).alias("after")), F.struct(F.col("before").alias("to"), F.lit(1).alias("after"))
    )
    dealt = rows.join(F.broadcast(before), ["id", "th"], "left")  # a row per range
    dealt = dealt.withColumn("place", F.explode(F.filter(places, lambda p: p["to"].isNotNull())))
    order = ["to", "after", "id", "th"]
    dealt = dealt.select("place.to", "place.after", "id", "th", "doc_id", "text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(tasks, "to").sortWithinPartitions(*order).select("to", "after", "doc_id", "text")
    names = ["doc_id", *(n for n, _, _ in COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = None, None
        for batch in batches:
            ids: list = []
            out: list[tuple] = []
            for to, after, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if to != part:
                    part, last = to, None
                own = sketch(text)
                if last is not None:
                    ids.append(last[0])
                    out.append(_compare(last[1], last[2], text, own))
                last = None if after else (doc_id, text, own)
            if ids:
                columns = [pa.array(c, t) for c, (_, _, t) in zip(zip(*out), COLUMNS)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names)

    return ordered.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} {t}" for n, t, _ in COLUMNS))
