"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: round after round, every feature in turn gets one shallow tree on the gradient that is left, which adds
to that feature's lookup table over its bins. The pairs of features that explain most of what remains then get two-way
tables in the same way. A text's score is the sum of its bins' entries, looked up for whole batches at once.
"""

from __future__ import annotations

import itertools
import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framegate.llm.common import map_batches, ship, text_or_empty

#: Labelled rows that a model is fitted on at most, taken by the hash of doc_id.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST_ROWS, RIDGE = 150, 60, 0.15, 3, 20, 1.0
THRESHOLD = 0.3

FEATURES = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "spaces", "plain_marks", "odd_marks",
    "bangs", "bars", "distinct_words", "repeats_previous", "most_frequent", "ends_in_mark", "capitalised", "long_words",
    "line_words", "distinct_lines", "single_letters",
)


def _classes() -> np.ndarray:
    kind = np.zeros((256, 7))
    for b in range(256):
        c = chr(b)
        kind[b] = (
            b >= 128 or c.isalpha(), b < 128 and c.isupper(), c.isdigit() and b < 128, b in b" \t\n\x0b\x0c\r",
            b in b".,;:'-\"()?", b < 128 and c.isprintable() and not c.isalnum() and b not in b" .,;:'-\"()?", c == "!",
        )
    return kind


KINDS = _classes()


def features(text: str) -> list[float]:
    """The numbers of ``FEATURES`` for a whole text; all zero for an empty one."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(FEATURES)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters, upper, digits, spaces, plain, odd, bangs = bytes_ @ KINDS
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x]
    n, size = max(1, len(words)), len(raw)
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    last = np.fromiter((w[-1] for w in words), np.uint8, len(words))
    first = np.fromiter((w[0] for w in words), np.uint8, len(words))
    return [
        np.log1p(size), np.log1p(len(words)), (size - spaces) / n, letters / size, upper / max(1.0, letters), digits / size,
        spaces / size, plain / size, odd / size, bangs / size, float(bytes_[124]) / size,
        len(counts) / n ** 0.9, sum(map(operator.eq, words, words[1:])) / n, max(counts.values(), default=0) / n,
        float(KINDS[last, 5].sum()) / n, float(KINDS[first, 1].sum()) / n, float((lengths > 12).sum()) / n,
        np.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), float((lengths == 1).sum()) / n,
    ]


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def _tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, float]:
    """A shallow tree over ordered bins, grown leaf by leaf at the best split: its step per bin, and its gain."""
    edges, gain = [0, len(gradient)], 0.0
    g, h, n = (np.r_[0.0, np.cumsum(x)] for x in (gradient, weight, rows))

    def part(a: np.ndarray, lo: int, hi: int) -> float:
        return a[hi] - a[lo]

    def worth(a: float, b: float) -> float:
        return a * a / (b + RIDGE)

    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for lo, hi in zip(edges, edges[1:]):
            at = np.arange(lo + 1, hi)
            fit = (n[at] - n[lo] >= LEAST_ROWS) & (n[hi] - n[at] >= LEAST_ROWS)
            if not fit.any():
                continue
            more = worth(g[at] - g[lo], h[at] - h[lo]) + worth(g[hi] - g[at], h[hi] - h[at]) - worth(part(g, lo, hi), part(h, lo, hi))
            k = int(np.argmax(np.where(fit, more, -1)))
            best = max(best, (float(more[k]), int(at[k])))
        if not best[1]:
            break
        gain += best[0]
        edges = sorted([*edges, best[1]])
    step = np.zeros(len(gradient))
    for lo, hi in zip(edges, edges[1:]):
        step[lo:hi] = part(g, lo, hi) / (part(h, lo, hi) + RIDGE)
    return step, gain


def _corner_tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of one cut on each axis over a two-way table: four leaves at most."""
    g, h, n = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight, rows))
    best, step = 1e-9, np.zeros_like(gradient)
    i, j = np.arange(1, gradient.shape[0])[:, None], np.arange(1, gradient.shape[1])[None, :]

    def four(a: np.ndarray) -> np.ndarray:
        near, low, left = a[i, j], a[i, -1], a[-1, j]
        return np.stack([near, low - near, left - near, a[-1, -1] - low - left + near])

    fg, fh, fn = four(g), four(h), four(n)
    gain = (fg**2 / (fh + RIDGE)).sum(0)
    gain = np.where((fn >= LEAST_ROWS).sum(0) >= 2, gain - g[-1, -1] ** 2 / (h[-1, -1] + RIDGE), -1)
    if gain.size and gain.max() > best:
        x, y = np.unravel_index(int(np.argmax(gain)), gain.shape)
        leaf = fg[:, x, y] / (fh[:, x, y] + RIDGE)
        for k, (a, b) in enumerate(itertools.product((slice(0, x + 1), slice(x + 1, None)), (slice(0, y + 1), slice(y + 1, None)))):
            step[a, b] = leaf[k]
        best = float(gain.max())
    return step, best


class Model:
    """``edges``: bin borders per feature; ``tables``: entry per bin; ``pairs``: two-way tables of coarser bins."""

    def __init__(self, intercept: float = 0.0):
        self.intercept = intercept
        self.edges: list[np.ndarray] = []
        self.coarse: list[np.ndarray] = []
        self.tables: list[np.ndarray] = []
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        for (i, j), table in self.pairs.items():
            total += table[np.searchsorted(self.coarse[i], x[:, i], "right"), np.searchsorted(self.coarse[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit the tables; with no labels every score is 0.5, with one class it is that class's smoothed share."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    borders = lambda n, v: np.unique(np.quantile(v, np.linspace(0, 1, n + 1)[1:-1], method="higher"))
    model.edges = [borders(BINS, v) for v in x.T]
    model.coarse = [borders(PAIR_BINS, v) for v in x.T]
    bins = [np.searchsorted(e, v, "right") for e, v in zip(model.edges, x.T)]
    coarse = [np.searchsorted(e, v, "right") for e, v in zip(model.coarse, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k, own in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[k])
            step, _ = _tree(np.bincount(own, g, n), np.bincount(own, h, n), np.bincount(own, minlength=n))
            model.tables[k] += RATE * step
            total += RATE * step[own]

    cells = {}
    g, h = slopes()
    for i, j in itertools.combinations(range(x.shape[1]), 2):
        shape = (len(model.coarse[i]) + 1, len(model.coarse[j]) + 1)
        if min(shape) > 1:
            cells[i, j] = (coarse[i] * shape[1] + coarse[j], shape)

    def pair_step(key: tuple[int, int]) -> tuple[np.ndarray, float]:
        own, shape = cells[key]
        size = shape[0] * shape[1]
        sums = (np.bincount(own, v, size).reshape(shape) for v in (g, h, np.ones(len(y))))
        return _corner_tree(*sums)

    chosen = sorted(cells, key=lambda key: (-pair_step(key)[1], key))[:PAIRS]
    model.pairs = {key: np.zeros(cells[key][1]) for key in chosen}
    for _ in range(PAIR_ROUNDS):
        for key in chosen:
            g, h = slopes()
            step, _ = pair_step(key)
            model.pairs[key] += RATE * step
            total += RATE * step.ravel()[cells[key][0]]
    return model


def feature_rows(docs: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns and ``x``, the features of the whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([features(t) for t in batch.column(len(kept)).to_pylist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], x], [*kept, "x"])

    rows = docs.select(*kept, text_or_empty())
    return map_batches(rows, run, ", ".join(f"{n} {t}" for n, t in rows.dtypes[: len(kept)]) + ", x array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that are not held out (a bounded sample, by the hash of doc_id).

    Labels other than 0 and 1 are no labels. The sample is the only side that is broadcast and collected; of rows that
    repeat a labelled doc_id, one text of the smallest hash is learned from.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    labelled = labelled.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    found = feature_rows(labelled, "doc_id", "quality")
    table = found.select("doc_id", "quality", "x").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(table["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, table["quality"].to_numpy(float))


def classify(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    A null text is empty; empty texts get the score of their bins like any other. Repeated rows and null ids keep their
    rows; a null id is not held out. Columns beside doc_id and text play no part; an empty table gives no rows.
    """
    shared = ship(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = shared().score(np.array([features(t) for t in batch.column(2).to_pylist()]))
        columns = [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")), text_or_empty())
    return map_batches(rows, run, "doc_id long, held_out boolean, score double, predicted int")
