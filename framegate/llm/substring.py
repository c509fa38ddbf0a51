"""Removal of passages that an earlier document already holds, by matching statistics on suffix automata.

Reference shards: every ``window`` consecutive words are assigned to their smallest hash of ``GRAM`` words (their
anchor). Runs of windows with one anchor are segments; equal windows have equal anchors, so windows only have to be
compared below one anchor. Anchors of one document alone drop out with an aggregate. What is left, one copy of each
distinct segment, is the reference; it is dealt by anchor into shards of bounded size. Each shard's automaton carries
the smallest doc_id of every state, and the segments of the documents are streamed through it: where the matching
statistic reaches the window's length, the state says in which document that window comes first.

An anchor with more than ``VARIANTS`` distinct segments (a passage in very many contexts) is not gathered: its windows
are compared by an aggregate on 128 bits of hash each, which gives the same answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from framegate.llm.common import extend, map_batches, order_id, stage, text_or_empty, unstage

WINDOW, GRAM, VARIANTS = 50, 25, 256
#: Words of a reference shard, about (its automaton takes some 400 bytes a word); words handled at a time.
SHARD_WORDS, STEP = 50_000, 1 << 17
WORD = re.compile(rb"[^\x20\x09-\x0d]+")
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
SEGMENTS = "anchor long, variant long, id long, th long, start int, n int"


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, made once in a task."""
    if multiplier not in _POWERS:
        inverse = pow(multiplier, -1, 1 << 64)
        up, down = (np.cumprod(np.r_[np.uint64(1), np.full(2 * STEP, m, np.uint64)]) for m in (multiplier, inverse))
        _POWERS[multiplier] = up, down
    return _POWERS[multiplier]


class Rolling:
    """Hashes of any run of words, from prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray, multiplier: int):
        up, self.down = _powers(multiplier)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = (self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64)
        found ^= found >> np.uint64(32)
        found *= np.uint64(0xFF51AFD7ED558CCD)
        return found ^ (found >> np.uint64(29))


def word_values(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first smallest of each ``width`` values in a row."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        later = best[step:] < best[:-step]
        best, at = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step])
        span += step
    return at


def _segments(runs: list[tuple[int, int, np.ndarray]], window: int, gram: int) -> list[np.ndarray]:
    """Segments of (row, first word, word values) runs: anchor, variant, row, start, number of windows."""
    values = np.concatenate([r[2] for r in runs])
    sizes = np.array([len(r[2]) for r in runs])
    run = np.repeat(np.arange(len(runs)), sizes)
    base = np.cumsum(sizes) - sizes
    grams = np.arange(len(values) - gram + 1)
    hashes = Rolling(values, MULTIPLIERS[0])(grams, grams + gram)
    at = _least(hashes, window - gram + 1)
    valid = run[: len(values) - window + 1] == run[window - 1 :]
    fresh = valid & np.r_[True, (at[1:] != at[:-1]) | ~valid[:-1]]
    starts = np.flatnonzero(fresh)
    n = np.add.reduceat(valid, starts, dtype=np.int64) if len(starts) else np.empty(0, np.int64)
    variant = Rolling(values, MULTIPLIERS[1])(starts, starts + n + window - 1)
    rows, first = np.array([r[0] for r in runs])[run[starts]], np.array([r[1] for r in runs])[run[starts]]
    return [hashes[at[starts]].view(np.int64), variant.view(np.int64), rows, first + starts - base[run[starts]], n]


def segments(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The segments of all documents ``(id, th, text)``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        found: list[list[np.ndarray]] = []
        runs: list[tuple[int, int, np.ndarray]] = []
        held = 0
        for row, text in enumerate(batch.column(2).to_pylist()):
            words = text.encode().split()
            for lo in range(0, len(words) - window + 1, STEP):
                part = word_values(words[lo : lo + STEP + window - 1])
                if runs and held + len(part) > STEP:
                    found.append(_segments(runs, window, gram))
                    runs, held = [], 0
                runs.append((row, lo, part))
                held += len(part)
        if runs:
            found.append(_segments(runs, window, gram))
        if not found:
            return None
        anchor, variant, rows, start, n = (np.concatenate(x) for x in zip(*found))
        columns = [anchor, variant, ids[rows], hashes[rows], start.astype(np.int32), n.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "variant", "id", "th", "start", "n"])

    return map_batches(docs.select("id", "th", "text"), run, SEGMENTS)


class SuffixAutomaton:
    """Automaton of several word sequences; ``first`` is the smallest document in which a state's strings occur."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [np.iinfo(np.int64).max]

    def _state(self, nxt: dict[bytes, int], link: int, length: int, first: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def add(self, words: list[bytes], doc: int) -> None:
        nxt, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for word in words:
            found = nxt[last].get(word)
            if found is not None and length[found] == length[last] + 1:
                last = found
            else:
                state = None if found is not None else self._state({}, 0, length[last] + 1, doc)
                p = last
                while state is not None and p != -1 and word not in nxt[p]:
                    nxt[p][word] = state
                    p = link[p]
                if p != -1:
                    q = nxt[p][word]
                    if length[q] == length[p] + 1:
                        target = q
                    else:
                        target = self._state(dict(nxt[q]), link[q], length[p] + 1, np.iinfo(np.int64).max)
                        while p != -1 and nxt[p].get(word) == q:
                            nxt[p][word] = target
                            p = link[p]
                        link[q] = target
                    if state is None:
                        state = target
                    else:
                        link[state] = target
                last = state
            if doc < first[last]:
                first[last] = doc

    def settle(self) -> None:
        """Hand the smallest document of every state to the shorter strings that end where its strings end."""
        for state in np.argsort(-np.array(self.length), kind="stable").tolist()[:-1]:
            parent = self.link[state]
            if self.first[state] < self.first[parent]:
                self.first[parent] = self.first[state]

    def first_documents(self, words: list[bytes], window: int) -> list[int]:
        """For each window of ``words``, the first document that holds it; the largest integer if none does."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            if word in nxt[state]:
                state, matched = nxt[state][word], matched + 1
            while length[link[state]] >= window:
                state = link[state]
            matched = min(matched, window)
            if i >= window - 1:
                out.append(first[state] if matched == window else np.iinfo(np.int64).max)
        return out


def _fetch(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The words of the ``wanted`` segments, from the document where each comes first."""
    lists = wanted.groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "variant", "start", "n", "many")).alias("list"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = batch.column(0).to_pylist(), []
        for doc, text, wanted in zip(ids, batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = text.encode().split()
            for s in wanted:
                part = b" ".join(words[s["start"] : s["start"] + s["n"] + window - 1])
                rows.append((s["anchor"], s["variant"], doc, s["many"], part))
        anchor, variant, doc, many, part = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(variant), pa.array(doc), pa.array(many), pa.array(part, pa.binary())],
            ["anchor", "variant", "id", "many", "words"],
        )

    texts = docs.join(lists, ["id", "th"]).select("id", "text", "list")
    return map_batches(texts, run, "anchor long, variant long, id long, many boolean, words binary")


def _by_automaton(reference: DataFrame, shards: int, window: int) -> DataFrame:
    """``anchor, variant, firsts``: the first document of each window of each reference segment."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.drop_duplicates(["anchor", "variant"])
        sequences = [w.split() for w in shard["words"]]
        automaton = SuffixAutomaton()
        for words, doc in zip(sequences, shard["id"].tolist()):
            automaton.add(words, doc)
        automaton.settle()
        firsts = [automaton.first_documents(words, window) for words in sequences]
        return pd.DataFrame({"anchor": shard["anchor"], "variant": shard["variant"], "firsts": firsts})

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    rows = reference.select(shard, "anchor", "variant", "id", "words")
    return rows.groupBy("shard").applyInPandas(run, "anchor long, variant long, firsts array<long>")


def _by_window(reference: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many segments, by an aggregate over window hashes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for anchor, variant, doc, part in zip(*(batch.column(i).to_pylist() for i in range(4))):
            values = word_values(part.split())
            at = np.arange(len(values) - window + 1)
            x, y = (Rolling(values, m)(at, at + window).view(np.int64) for m in MULTIPLIERS)
            out.append((np.full(len(at), anchor), np.full(len(at), variant), np.full(len(at), doc), at.astype(np.int32), x, y))
        columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
        return pa.RecordBatch.from_arrays(columns, ["anchor", "variant", "id", "at", "x", "y"])

    rows = reference.select("anchor", "variant", "id", "words")
    windows = stage(map_batches(rows, run, "anchor long, variant long, id long, at int, x long, y long"), "windows")
    least = stage(windows.groupBy("x", "y").agg(F.min("id").alias("first")), "least")
    by_row = windows.join(least, ["x", "y"]).groupBy("anchor", "variant").agg(
        F.sort_array(F.collect_set(F.struct("at", "first"))).alias("list")
    )
    return by_row.select("anchor", "variant", F.transform("list", lambda w: w["first"]).alias("firsts"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, variants: int = VARIANTS) -> DataFrame:
    """``id, th, spans``: per document with a repeat, (first word, bit mask of repeated windows from there)."""
    found = stage(segments(docs, window, gram), "segments")
    ends = found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    # Written first, so that a join on a very common anchor can be split.
    anchors = stage(ends.where("lo < hi").select("anchor"), "anchors")
    held = stage(found.join(anchors, "anchor"), "shared")
    unstage(found, anchors)
    distinct = stage(
        held.groupBy("anchor", "variant").agg(F.min(F.struct("id", "th", "start", "n")).alias("f")).select("anchor", "variant", "f.*"),
        "variants",
    )
    many = distinct.groupBy("anchor").agg((F.count("*") > variants).alias("many"))
    words = stage(_fetch(docs, distinct.join(many, "anchor"), window), "reference")
    shards = max(1, words.where("not many").count() * (window + 13) // SHARD_WORDS)
    firsts = _by_automaton(words.where("not many"), shards, window).unionByName(_by_window(words.where("many"), window))
    firsts = stage(firsts, "firsts")
    unstage(words, distinct)
    mask = F.expr("aggregate(reverse(firsts), 0L, (mask, x) -> 2 * mask + if(x < id, 1L, 0L))")
    marked = held.join(firsts, ["anchor", "variant"]).select("id", "th", "start", mask.alias("mask")).where("mask <> 0")
    return marked.groupBy("id", "th").agg(F.collect_list(F.struct("start", "mask")).alias("spans"))


def cut_repeats(text: str, spans: list[dict] | None, window: int = WINDOW) -> tuple[str, int, int]:
    """The text without the words of the marked windows, its words and those removed. What is kept keeps its spacing."""
    raw = text.encode()
    if not spans:
        return text, len(raw.split()), 0
    at = np.array([m.span() for m in WORD.finditer(raw)])
    change = np.zeros(len(at) + 1, np.int64)
    for span in spans:
        for bit in range(int(span["mask"]).bit_length()):
            if span["mask"] >> bit & 1:
                change[span["start"] + bit] += 1
                change[span["start"] + bit + window] -= 1
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    kept, lo = [], 0
    for a, b in edges.reshape(-1, 2).tolist():
        kept.append(raw[lo : at[a, 0]])
        lo = at[b, 0] if b < len(at) else len(raw)
    kept.append(raw[lo:])
    return b"".join(kept).decode(), len(at), int(gone.sum())


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, variants: int = VARIANTS, carry: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The ``carry`` columns of every row of ``docs``, with left (what is left of the text), n_words, n_removed.

    A word goes if some ``window`` consecutive words that hold it also stand in a document with a smaller doc_id, as
    judged on the input. A null text is empty; texts shorter than the window stay as they are. Rows with one doc_id are
    one document: they take nothing from each other. A null doc_id counts as the largest. Repeated rows keep their rows.
    Other columns are left out; an empty table gives no rows.
    """
    keyed = docs.select(*carry, order_id().alias("id"), text_or_empty().alias("__text")).withColumn("th", F.xxhash64("__text"))
    spans = repeated_spans(keyed.select("id", "th", F.col("__text").alias("text")), window, gram, variants)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, marks = batch.column("__text").to_pylist(), batch.column("__spans").to_pylist()
        text, words, gone = zip(*(cut_repeats(t, s, window) for t, s in zip(texts, marks)))
        return [pa.array(text), pa.array(words, pa.int64()), pa.array(gone, pa.int64())]

    joined = keyed.join(spans.withColumnRenamed("spans", "__spans"), ["id", "th"], "left").select(*carry, "__text", "__spans")
    return extend(joined, list(carry), run, "left string, n_words long, n_removed long")


def keep_rest(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what is left of their texts; rows of which nothing is left go. Untouched rows stay as
    they are, others get their new number of characters."""
    inner = docs.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(docs.columns)), "doc_id", "text")
    found = remove_repeats(inner, carry=tuple(f"__c{i}" for i in range(len(docs.columns))))
    kept = found.where("n_removed = 0 OR n_removed < n_words")
    cut = F.col("n_removed") > 0
    columns = []
    for i, c in enumerate(docs.columns):
        new = {"text": F.col("left"), "n_chars": F.length("left").cast("long")}.get(c)
        old = F.col(f"__c{i}")
        columns.append((F.when(cut, new).otherwise(old) if new is not None else old).alias(c))
    return kept.select(*columns)
