"""Language identification by mixture inference.

Every language is a distribution over hashed byte trigrams, counted over all labelled documents. A document is a mixture:
expectation-maximisation finds the proportions of all languages, then nested sets of the largest ones compete by
penalised likelihood, and the proportions within the chosen set are the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from framegate.llm.common import bounded_batches, extend, ship

BUCKETS, GRAM = 1 << 15, 3
#: Weight of the mean language distribution in EM, in trigrams; likelihood that one more language must win, in logs of
#: the number of trigrams; neighbouring trigrams share letters, so evidence counts one GRAM-th.
PRIOR, PENALTY, ROUNDS, TOLERANCE = 1.0, 3.0, 40, 1e-4
SMOOTHING = 0.05
#: Trigrams a text must have before it can count as noise.
NOISE_GRAMS = 30
UNKNOWN = "und"
RUN = re.compile(r"[^\W\d_]+")


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct trigram buckets of the letters of a text, with their counts; None if it has no letter."""
    runs = RUN.findall(text or "")
    if not runs or not any(c.isalpha() for run in runs for c in run):
        return None
    raw = np.frombuffer(f" {' '.join(runs).lower()} ".encode(), np.uint8).astype(np.uint32)
    codes = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(0x9E3779B1)
    return np.unique(codes >> np.uint32(32 - BUCKETS.bit_length() + 1), return_counts=True)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


class Model:
    """``names`` and, per language, the probability of every bucket."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        total = counts.sum(1, keepdims=True)
        self.probability = (counts + SMOOTHING) / (total + SMOOTHING * counts.shape[1])
        self.prior = (total[:, 0] + 1.0) / (total.sum() + len(names))

    def _mix(self, likelihood: np.ndarray, counts: np.ndarray, share: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, float]:
        total = counts.sum() + PRIOR
        for _ in range(ROUNDS):
            mixed = share @ likelihood
            new = (share * (likelihood @ (counts / mixed)) + PRIOR * prior) / total
            done = np.abs(new - share).max() < TOLERANCE
            share = new
            if done:
                break
        return share, float(counts @ np.log(share @ likelihood))

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float], bool]:
        """Main language, score, proportions, and whether the languages explain the text (uniform noise does not)."""
        found = grams(text)
        if found is None or not self.names:
            return UNKNOWN, 0.0, {}, found is not None
        buckets, counts = found
        likelihood, n = self.probability[:, buckets], counts.sum()
        single = np.log(likelihood) @ counts
        share, _ = self._mix(likelihood, counts, np.full(len(self.names), 1 / len(self.names)), self.prior)
        order = np.argsort(-share, kind="stable")
        best = max(order[:1].tolist() + [int(np.argmax(single / GRAM + np.log(self.prior)))], key=lambda i: (single[i], -i))
        chosen, proportions = [best], np.ones(1)
        value = single[best] / GRAM
        rest = [int(i) for i in order if i != best]
        for k in range(1, len(rest) + 1):
            own = [best, *rest[:k]]
            start = share[own] / share[own].sum()
            mixed, log = self._mix(likelihood[own], counts, start, self.prior[own] / self.prior[own].sum())
            if log / GRAM - PENALTY * k * np.log(n + 1) <= value:
                break
            chosen, proportions, value = own, mixed, log / GRAM - PENALTY * k * np.log(n + 1)
        top = int(np.argmax(proportions))
        posterior = single / GRAM + np.log(self.prior)
        posterior = np.exp(posterior - posterior.max())
        sure = posterior[chosen].sum() / posterior.sum()
        score = float(min(1.0, max(0.0, proportions[top] * sure)))
        shares = {self.names[i]: float(p) for i, p in zip(chosen, proportions)}
        # Noise is one more candidate and has to win by as much as a language; a few letters prove nothing.
        lead = -n * np.log(BUCKETS) / GRAM - value
        known = bool(n < NOISE_GRAMS or lead <= PENALTY * np.log(n + 1))
        return self.names[chosen[top]], score, shares, known


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, bucket, n`` over all of ``docs(text, lang)``: each task sums what it reads before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (found := grams(text)) is not None:
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang][found[0]] += found[1]
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    bounded_batches(docs.sparkSession)
    parts = docs.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> Model:
    """Learn from ``text`` and non-null ``lang`` of documents that are not held out. The driver gets one number per
    language and bucket, whatever the size of the corpus."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    table = count_grams(rows).toPandas()
    names = sorted(table["lang"].unique())
    counts = np.zeros((len(names), BUCKETS))
    counts[np.searchsorted(names, table["lang"]) if names else [], table["bucket"].astype(int)] = table["n"]
    return Model(names, counts)


def identify(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of every row of ``docs``, with held_out, lang_pred, score, shares (map), known.

    A text that is null or has no letter is ``und`` with score 0; so is every text if nothing was learned. ``known`` is
    false for those without a letter, and where uniform noise explains a text of some length better than the learned
    languages do; if nothing was learned, only for the former. Very short texts lean on the languages' frequencies;
    ties go to the first name. Repeated rows and null ids keep their rows; a null id is not held out. Other columns play
    no part; an empty table gives no rows.
    """
    shared = ship(docs.sparkSession, model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        lang, score, shares, known = zip(*(shared().infer(t) for t in batch.column("__text").to_pylist()))
        maps = pa.array([list(s.items()) for s in shares], pa.map_(pa.string(), pa.float64()))
        return [batch.column("__held"), pa.array(lang), pa.array(score, pa.float64()), maps, pa.array(known)]

    rows = docs.select(*carry, held_out(F.col("doc_id")).alias("__held"), F.col("text").cast("string").alias("__text"))
    added = "held_out boolean, lang_pred string, score double, shares map<string,double>, known boolean"
    return extend(rows, list(carry), run, added)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in a language learned from ``docs``: no null or letterless texts, none that is closer to noise.

    If ``docs`` has no label to learn from (none at all, or only on held-out rows), only null and letterless texts go.
    """
    inner = docs.select(*(F.col(f"`{c}`").alias(f"__c{i}") for i, c in enumerate(docs.columns)), "doc_id", "text")
    found = identify(inner, train(docs), tuple(f"__c{i}" for i in range(len(docs.columns))))
    return found.where("known").select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)))
