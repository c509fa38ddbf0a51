"""Folds over ordered frame sequences.

A sequence is cut into chunks of as many frames, so one long video is many tasks. Each chunk needs the state left by
the chunk before it; that small table of chunk states is settled first, then all chunks run at once. The rows of a
chunk arrive sorted in Arrow batches and only the state is kept between batches, so no group is ever held as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from framegate.operators.order import grouped_rank, null_safe_join
from framegate.runtime import cut

CHUNK_FRAMES = 100_000
State = tuple[float, float]


def thin_decisions(index, value, last_index, last_value, min_gap: int, threshold: float):
    """Decision and score of each frame of a sorted run, given the last kept frame (NaN when none), and the new state."""
    decisions, scores = [], []
    for i, v in zip(index, value):
        score = np.nan
        if last_index != last_index:
            decision = "kept"
        elif i - last_index < min_gap:
            decision = "gap"
        else:
            score = abs(v - last_value)
            decision = "dedup" if score < threshold else "kept"
        if decision == "kept":
            last_index, last_value = i, v
        decisions.append(decision)
        scores.append(score)
    return decisions, scores, last_index, last_value


def _chunked(frames: DataFrame, key: str, index: str, value: str, chunk: int) -> DataFrame:
    """The frames with their place in their sequence and the chunk of that place: ``chunk`` rows each, so that frame numbers
    far apart don't make a chunk of each frame. Frames of one number are taken by value. Frames without a key are no
    sequence: each range of ``chunk`` numbers among them (``_span``) is one of its own."""
    rows = frames.select(
        key, F.when(F.col(key).isNull(), F.floor(F.col(index) / chunk).cast("bigint")).alias("_span"), F.col(index),
        F.col(value).cast("double").alias(value),
    )
    placed = grouped_rank(rows, [key, "_span"], [index, value], "_at")
    return placed.withColumn("_chunk", F.floor((F.col("_at") - 1) / chunk).cast("bigint"))


def _sorted_runs(rows: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Rows of every chunk in order, led by one row that carries the chunk's start state (``_s1``, ``_s2``)."""
    led = rows.withColumn("_lead", F.lit(False)).unionByName(starts.withColumn("_lead", F.lit(True)), allowMissingColumns=True)
    return led.repartition(key, "_span", "_chunk").sortWithinPartitions(key, "_span", "_chunk", F.col("_lead").desc(), "_at")


def _numbers(batch: pa.RecordBatch, *names: str) -> list[list[float]]:
    return [batch.column(n).cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).tolist() for n in names]


def _runs(batch: pa.RecordBatch, state: tuple) -> Iterator[tuple[int | None, int, int, tuple | None]]:
    """``(lead, begin, end, state)`` of the runs in a batch; the first one goes on from the batch before and has no lead."""
    first, second = _numbers(batch, "_s1", "_s2")
    leads = np.flatnonzero(batch.column("_lead").to_numpy(zero_copy_only=False)).tolist()
    yield None, 0, leads[0] if leads else batch.num_rows, state
    for lead, end in zip(leads, [*leads[1:], batch.num_rows]):
        yield lead, lead + 1, end, (first[lead], second[lead])


def _walk(
    batches: Iterator[pa.RecordBatch], names: Sequence[str], numbers: Sequence[str], step: Callable, made: Sequence[pa.Field]
) -> Iterator[pa.RecordBatch]:
    """Go through sorted runs: ``step(columns of numbers, state)`` gives a list per field of ``made``, and the state after."""
    state = (np.nan, np.nan)
    for batch in batches:
        columns, found = _numbers(batch, *numbers), [[] for _ in made]
        for _, begin, end, state in _runs(batch, state):
            if end > begin:
                *values, state = step(*[c[begin:end] for c in columns], state)
                for all_, some in zip(found, values):
                    all_.extend(some)
        rows = batch.select(names).filter(pc.invert(batch.column("_lead")))
        arrays = [pa.array(v, f.type) for v, f in zip(found, made)]
        yield pa.RecordBatch.from_arrays([*rows.columns, *arrays], [*names, *[f.name for f in made]])


def _ends(batches: Iterator[pa.RecordBatch], key: str, numbers: Sequence[str], step: Callable, made: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """One row per sorted run: its key, span, chunk and the numbers ``made`` from the state in which ``step`` leaves it."""
    name, kind, state, last = None, None, None, []

    def closed(some: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in some], t) for i, t in enumerate((kind, pa.int64(), pa.int64()))]
        ends = [pa.array([r[3][i] for r in some], pa.float64()) for i in range(len(made))]
        return pa.RecordBatch.from_arrays([*columns, *ends], [key, "_span", "_chunk", *made])

    for batch in batches:
        kind, out = batch.column(key).type, []
        columns, names = _numbers(batch, *numbers), [batch.column(c) for c in (key, "_span", "_chunk")]
        for lead, begin, end, start in _runs(batch, state):
            if lead is not None:
                if name is not None:
                    out.append((*name, state))
                name = [c[lead].as_py() for c in names]
            state = start
            if end > begin:
                state = step(*[c[begin:end] for c in columns], state)[-1]
        if out:
            yield closed(out)
    if name is not None:
        yield closed([(*name, state)])


def thin_sequence(
    frames: DataFrame, key: str, index: str, value: str, min_gap: int, threshold: float, chunk: int = CHUNK_FRAMES
) -> DataFrame:
    """Gap and change thinning: keep a frame at least ``min_gap`` after the last kept one whose value differs from
    the last kept one by ``threshold``. Adds ``decision`` (kept, gap, dedup) and ``score``.

    Exact for any length: chunks first run from an open start, then every chunk whose predecessor ended in another
    state runs again, until no start changes. The state usually agrees after one or two rounds; a sequence of one chunk
    takes none.
    """
    gap = max(0, min_gap)
    rows = cut(_chunked(frames, key, index, value, chunk))
    types = dict(rows.dtypes)
    sequence, run_of = [key, "_span"], [key, "_span", "_chunk"]

    def decide(indexes, values, state):
        decisions, scores, *state = thin_decisions(indexes, values, *state, gap, threshold)
        return decisions, [None if s != s else s for s in scores], tuple(state)

    nothing = F.lit(None).cast("double")
    chunks = cut(rows.select(*run_of).distinct().withColumns({"_s1": nothing, "_s2": nothing}))
    several = chunks.filter("_chunk > 0").select(*sequence).distinct()
    starts = cut(null_safe_join(chunks, several, sequence, "left_semi"))
    todo, ends = starts, None
    in_order = W.partitionBy(*sequence).orderBy("_chunk")  # one row per chunk
    while not todo.isEmpty():
        again = null_safe_join(rows, todo.select(*run_of), run_of, "left_semi")
        run = _sorted_runs(again, todo, key).mapInArrow(
            lambda b: _ends(b, key, [index, value], decide, ["_e1", "_e2"]), f"{key} {types[key]}, _span bigint, _chunk bigint, _e1 double, _e2 double"
        )
        run = run.withColumns({c: F.nanvl(c, nothing) for c in ("_e1", "_e2")})
        ends = cut(run if ends is None else run.unionByName(null_safe_join(ends, todo.select(*run_of), run_of, "left_anti")))
        moved = cut(ends.select(*run_of, *[F.lag(e).over(in_order).alias(s) for e, s in (("_e1", "_s1"), ("_e2", "_s2"))]))
        old = starts.withColumnsRenamed({"_s1": "_o1", "_s2": "_o2"})
        same = F.col("_s1").eqNullSafe(F.col("_o1")) & F.col("_s2").eqNullSafe(F.col("_o2"))
        todo = cut(null_safe_join(moved, old, run_of).filter(~same).drop("_o1", "_o2"))
        starts = moved
    whole = null_safe_join(chunks, several, sequence, "left_anti").unionByName(starts)
    schema = f"{key} {types[key]}, {index} {types[index]}, {value} double, decision string, score double"
    made = [pa.field("decision", pa.string()), pa.field("score", pa.float64())]
    return _sorted_runs(rows, whole, key).mapInArrow(lambda b: _walk(b, [key, index, value], [index, value], decide, made), schema)


def moving_average(
    frames: DataFrame, key: str, index: str, value: str, keep: float = 0.9, chunk: int = CHUNK_FRAMES
) -> DataFrame:
    """Exponential moving average per key, ``keep`` of the old value plus the rest of the new; starts at the first value,
    and again after a missing one.

    The recurrence is linear, so a chunk is summed up by how much of its start is left at its end and by what it adds; the
    chunk starts follow from those numbers, and each chunk then runs by itself.
    """
    rows = cut(_chunked(frames, key, index, value, chunk))
    types = dict(rows.dtypes)
    sequence, run_of = [key, "_span"], [key, "_span", "_chunk"]
    take = 1.0 - keep

    def average(values, state):
        now, out = state[0], []
        for v in values:
            now = v if now != now else keep * now + take * v
            out.append(now if now == now else None)
        return out, (now, state[1])

    def share(values, state):
        # From an open start, and from zero with what is left of a start; a missing value leaves nothing of either.
        first, zero, left = state
        for v in values:
            first = v if first != first else keep * first + take * v
            zero, left = (v, 0.0) if zero != zero else (keep * zero + take * v, left * keep)
        return (first, zero, left),

    nothing = F.lit(None).cast("double")
    chunks = cut(rows.select(*run_of).distinct().withColumns({"_s1": nothing, "_s2": nothing}))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _ends(batches, key, [value], lambda v, s: share(v, s if len(s) == 3 else (np.nan, 0.0, 1.0)), ["_first", "_zero", "_left"])

    ends = _sorted_runs(rows, chunks, key).mapInArrow(shares, f"{key} {types[key]}, _span bigint, _chunk bigint, _first double, _zero double, _left double")
    lead = ends.withColumn("_lead", F.lit(False)).repartition(*sequence).sortWithinPartitions(*run_of)

    def begin_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.nan
        for batch in batches:
            starts = []
            for at, first, zero, left in zip(batch.column("_chunk").to_pylist(), *_numbers(batch, "_first", "_zero", "_left")):
                state = np.nan if at == 0 else state
                starts.append(state)
                # Nothing of a start is left after a missing value, nor is there anything to keep of an open one.
                state = first if state != state else (left * state + zero)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in run_of], pa.array(starts, pa.float64())], [*run_of, "_s1"])

    starts = lead.mapInArrow(begin_states, f"{key} {types[key]}, _span bigint, _chunk bigint, _s1 double").withColumn("_s2", nothing)
    schema = f"{key} {types[key]}, {index} {types[index]}, {value} double, average double"
    made = [pa.field("average", pa.float64())]
    return _sorted_runs(rows, starts, key).mapInArrow(lambda b: _walk(b, [key, index, value], [value], average, made), schema)
