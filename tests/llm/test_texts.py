"""Operators that keep a row per document: language, quality, licences, fingerprints."""

import hashlib
import math
import random
import re
import zlib

import edge
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from framegate.llm import fingerprints, language, licenses, quality
from framegate.llm.queries import QUERIES

TABLES = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    found = QUERIES["op4_language_id"](spark, TABLES)
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    right = [r["lang"] == r["lang_pred"] for r in rows]
    longer = [r["lang"] == r["lang_pred"] for r in rows if r["n"] >= 100]
    assert sum(right) >= 0.97 * len(right) and sum(longer) >= 0.995 * len(longer)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_learns_nothing_from_held_out_rows(spark):
    docs = edge.documents(spark)
    held = docs.where(language.held_out(F.col("doc_id")))
    model, rest = language.train(docs), language.train(docs.join(held.select("doc_id"), "doc_id", "left_anti"))
    assert held.count() > 0 and model.names == rest.names and np.allclose(model.probability, rest.probability)


def test_language_mixture_and_edge_cases(spark):
    table = spark.read.parquet(f"{TABLES}/documents.parquet")
    model = language.train(table)
    text = {r["lang"]: r["text"] for r in table.where("length(text) between 3000 and 6000").orderBy("doc_id").collect()}
    mixed = text["en"][:3000] + " " + text["de"][:1500]
    name, score, shares, known = model.infer(mixed)
    assert name == "en" and set(shares) == {"en", "de"} and abs(shares["en"] - 2 / 3) < 0.05 and known and score < 0.75
    assert set(model.infer(text["fr"])[2]) == {"fr"}
    for nothing in (None, "", "12 34 !! \n", "² ½"):
        assert model.infer(nothing) == ("und", 0.0, {}, False)
    clean = [(i, edge.prose(i, 80), None) for i in range(20)] + [(20, None, None), (21, "12 !", None)]
    unlabelled = spark.createDataFrame(clean, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in language.keep_identified(unlabelled).collect()) == list(range(20))
    assert not model.infer("漢字仮名交じり文の文章です。" * 20)[3]
    docs = edge.documents(spark)
    found = edge.collected(language.identify(docs, language.train(docs)))
    assert len(found) == len(edge.rows()) and {r["lang_pred"] for r in found} <= {"en", "de", "und"}
    assert {r["doc_id"] for r in found if r["lang_pred"] == "und"} == {3, 4, 5, 17}
    assert language.identify(docs, language.train(docs.limit(0))).where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert language.identify(docs.limit(0), model).count() == 0
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (3, 4, 5, 17)").count() == 0


def plain_mixture(likelihood, counts, share, prior, weight=1.0, rounds=40, tolerance=1e-4):
    """Expectation-maximisation with every trigram and language in a loop."""
    for _ in range(rounds):
        new = [weight * p for p in prior]
        for j, n in enumerate(counts):
            parts = [s * row[j] for s, row in zip(share, likelihood)]
            for i, part in enumerate(parts):
                new[i] += n * part / sum(parts)
        new = [v / (sum(counts) + weight) for v in new]
        moved = max(abs(a - b) for a, b in zip(new, share))
        share = new
        if moved < tolerance:
            break
    log = sum(n * math.log(sum(s * row[j] for s, row in zip(share, likelihood))) for j, n in enumerate(counts))
    return share, log


def test_mixture_equals_a_plain_em(spark):
    model = language.train(spark.read.parquet(f"{edge.SF_DIR}/documents.parquet"))
    for row in spark.read.parquet(f"{edge.SF_DIR}/documents.parquet").where("length(text) between 200 and 900").limit(15).collect():
        buckets, counts = language.grams(row["text"])
        likelihood = model.probability[:, buckets]
        start = np.full(len(model.names), 1 / len(model.names))
        share, log = model._mix(likelihood, counts, start, model.prior)
        plain, value = plain_mixture(likelihood.tolist(), counts.tolist(), start.tolist(), model.prior.tolist())
        assert np.allclose(share, plain, atol=1e-9) and log == pytest.approx(value, rel=1e-9)
        name, _, shares, _ = model.infer(row["text"])
        assert max(shares, key=shares.get) == name and sum(shares.values()) == pytest.approx(1, abs=1e-6)


def test_language_likelihood_never_falls():
    """EM: more rounds do not lower the (penalised by the prior) likelihood of a mixture."""
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, (3, language.BUCKETS)).astype(float)
    model = language.Model(["a", "b", "c"], counts)
    likelihood, n = model.probability[:, :400], rng.integers(1, 5, 400)
    share, values = np.full(3, 1 / 3), []
    for _ in range(30):
        values.append(n @ np.log(share @ likelihood) + language.PRIOR * model.prior @ np.log(share))
        mixed = share @ likelihood
        share = (share * (likelihood @ (n / mixed)) + language.PRIOR * model.prior) / (n.sum() + language.PRIOR)
    assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))


def test_quality_on_held_out_documents(spark):
    found = QUERIES["op2_quality_classifier"](spark, TABLES)
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    right = sum(r["predicted"] == r["quality"] for r in rows)
    assert right >= 0.93 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_quality_edge_cases(spark):
    docs = edge.documents(spark)
    labels = spark.createDataFrame(
        [(0, 1, "a"), (1, None, "b"), (None, 1, "c"), (2, 7, "d"), (13, 0, "e"), (13, 0, "e"), (99, 1, "f")], "doc_id long, quality int, score string"
    )
    found = edge.collected(quality.classify(docs, quality.train(docs, labels)))
    assert len(found) == len(edge.rows()) and all(0 <= r["score"] <= 1 for r in found)
    nothing = edge.collected(quality.classify(docs, quality.train(docs, labels.limit(0))))
    assert {r["score"] for r in nothing} == {0.5}
    repeated = docs.unionByName(docs.where("doc_id = 13")).unionByName(docs.where("doc_id = 13"))
    once, again = quality.train(docs, labels), quality.train(repeated, labels)
    assert edge.collected(quality.classify(docs, once)) == edge.collected(quality.classify(docs, again))
    assert quality.classify(docs.limit(0), quality.Model()).count() == 0
    assert quality.features("") == [0.0] * len(quality.FEATURES)
    assert len(quality.features("x" * 100 + " \n")) == len(quality.FEATURES)


def test_batched_scores_equal_a_plain_loop_over_bins(spark):
    docs, labels = (spark.read.parquet(f"{edge.SF_DIR}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert len(model.pairs) == 8 and len(model.tables) == len(quality.FEATURES)
    found = {r["doc_id"]: r["score"] for r in quality.classify(docs, model).collect()}
    for row in docs.collect():
        x, total = quality.features(row["text"] or ""), model.intercept
        at = [sum(v >= e for e in edges) for v, edges in zip(x, model.edges)]
        coarse = [sum(v >= e for e in edges) for v, edges in zip(x, model.coarse)]
        for k, b in enumerate(at):
            total += model.tables[k][b]
        for (i, j), table in model.pairs.items():
            total += table[coarse[i]][coarse[j]]
        assert found[row["doc_id"]] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-12)


def test_quality_tables_learn_steps_and_interactions():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(4000, 4))
    step = (x[:, 0] > 0.5).astype(float)
    assert ((quality.fit(x, step).score(x) > 0.5) == step).mean() > 0.97
    cross = ((x[:, 1] > 0.5) ^ (x[:, 2] > 0.5)).astype(float)
    model = quality.fit(x, cross)
    assert (1, 2) in model.pairs and ((model.score(x) > 0.5) == cross).mean() > 0.9
    one = quality.fit(x, np.ones(4000)).score(x)
    assert (one > 0.99).all() and len(set(one)) == 1


def plain_base(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        want = phrase.split()
        found = [i for i in range(len(words)) if words[i : i + len(want)] == want]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@pytest.mark.parametrize("which", ["edge", "table"])
def test_base_phrases_against_word_lists(spark, which):
    docs = edge.documents(spark) if which == "edge" else spark.read.parquet(f"{TABLES}/documents.parquet")
    found = sorted(
        ((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.find_licenses(docs).collect()),
        key=repr,
    )
    assert found == sorted(((r["doc_id"], *plain_base(r["text"])) for r in docs.select("doc_id", "text").collect()), key=repr)
    assert sum(r[2] for r in found) > 0


def test_base_phrases_that_touch():
    text = "MIT License mit license cc by cc by mit\nlicense gnu general public license cc by"
    assert licenses.scan(text)[:5] == plain_base(text)


def test_seeds_lose_no_match_within_the_bound():
    """Every text within the bound of a notice is found; what is found is within the bound."""
    rng = random.Random(6)
    for notice, label, edits in licenses.NOTICES:
        for _ in range(15):
            chars = list(notice)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(1, len(chars) - 1)
                kind = rng.choice("ids")
                chars[at : at + (kind != "i")] = rng.choice("abcxyz") if kind != "d" else ""
            text = f"{edge.prose(rng.randrange(999), 40)} {''.join(chars)} {edge.prose(rng.randrange(999), 40)}"
            line = licenses.folded(text)
            raw = licenses.fuzzy_spans(line, licenses.NOTICES)
            assert any(s[0] == label and s[3] <= edits for s in raw), (notice, "".join(chars))
            words, spans = line.split(), licenses.scan(text)[7]
            assert spans
            for s in spans:
                part = " ".join(words[s["first"] : s["last"] + 1])
                bound = {(n, k) for n, name, k in licenses.NOTICES if name == s["label"]}
                assert any(regex.search(f"(?:{n}){{e<={k}}}", f" {part} ") for n, k in bound)


def test_the_best_of_overlapping_notices_counts():
    found = licenses.scan("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.")
    assert found[4] == "cc-by" and found[5] == "cc-by,cc-by-nc" and [s["label"] for s in found[7]] == ["cc-by-nc", "cc-by"]
    assert [(s["first"], s["last"]) for s in found[7]] == [(0, 4), (7, 10)]


def plain_spans(line, notices):
    """The best match that starts at each character, for every notice; of those that overlap, the best."""
    found = []
    for notice, label, edits in notices:
        pattern = regex.compile(f"(?be)(?:{notice}){{e<={edits}}}")
        for at in range(len(line)):
            m = pattern.match(line, at, min(len(line), at + len(notice) + edits))
            if m and m.end() > m.start():
                wrong = sum(m.fuzzy_counts)
                found.append((label, m.start(), m.end(), wrong, 1 - wrong / len(notice)))
    return licenses.best_spans(found)


def test_spans_equal_a_search_at_every_place():
    rng = random.Random(11)
    chosen = rng.sample(licenses.NOTICES, 6) + [n for n in licenses.NOTICES if "cc by" in n[0]]
    for _ in range(25):
        parts = []
        for _ in range(6):
            notice, _, edits = rng.choice(chosen)
            chars = list(notice)
            for _ in range(rng.randint(0, edits)):
                chars[rng.randrange(2, len(chars) - 2)] = rng.choice("qxz")
            parts += ["".join(chars), rng.choice(["", "or", "see", edge.prose(rng.randrange(99), 3)])]
        line = licenses.folded(" ".join(parts))
        shown = [[(s[0], line[s[1] : s[2]].strip(), s[3]) for s in found] for found in (licenses.best_spans(licenses.fuzzy_spans(line, tuple(chosen))), plain_spans(line, chosen))]
        assert shown[0] == shown[1]


def test_near_notices_side_by_side_are_all_found():
    for n in (10, 1000, 40_000):
        spans = licenses.scan("mozila publc license or " * n)[7]
        assert [(s["label"], s["first"], s["edits"]) for s in spans] == [("mpl", 4 * i, 2) for i in range(n)]


def test_near_notices_get_labels(spark):
    docs = spark.createDataFrame([(1, "Released under the MTI Licence"), (2, "All rights reservd."), (3, "nothing here")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.find_licenses(docs).collect()}
    assert found[1]["base_labels"] == "" and found[1]["labels"] == "mit" and found[1]["spans"][0]["edits"] == 3
    assert found[2]["labels"] == "all-rights-reserved" and 0.8 < found[2]["score"] < 1 and found[2]["spans"][0]["edits"] == 1
    assert found[3]["labels"] == "" and found[3]["score"] == 0.0
    assert licenses.find_licenses(docs.limit(0)).count() == 0


def plain_sketch(text):
    """The sketch by whole numbers, a shingle at a time."""
    words = [xxhash.xxh64_intdigest(w) for w in re.split(rb"[\x20\x09-\x0d]+", text.encode().lower()) if w]
    width, mask, hashes = min(5, len(words)), (1 << 64) - 1, set()
    for i in range(len(words) - width + 1 if width else 0):
        h = width
        for w in words[i : i + width]:
            h = (h * 0x9E3779B97F4A7C15 + w) & mask
        h = (h ^ h >> 31) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 29) * 0x94D049BB133111EB & mask
        hashes.add(h ^ h >> 32)
    return {h for h in hashes if h < 2**61} or ({min(hashes)} if hashes else set())


def test_weaker_notices_beside_a_better_one_are_found():
    """Several near notices in one window: a better match to their right or left hides none of them."""
    texts = {
        "Mozila Public License or Mozilla Publc License v2, Mozilla Public License": [(0, 2, 1), (4, 6, 1), (8, 10, 0)],
        "Mozilla Public License, Mozila Public License, Mozilla Publc Licens": [(0, 2, 0), (3, 5, 1), (6, 8, 2)],
        "Mozila Publc License Mozila Public License Mozilla Public License Mozila Publc License": [(0, 2, 2), (3, 5, 1), (6, 8, 0), (9, 11, 2)],
    }
    for text, places in texts.items():
        spans = licenses.scan(text)[-1]
        assert [(s["first"], s["last"], s["edits"]) for s in spans if s["label"] == "mpl"] == places


@pytest.mark.parametrize("which", ["edge", "table"])
def test_fingerprints_of_a_text_its_edit_and_the_next(spark, which):
    docs = edge.documents(spark).where("doc_id is not null and doc_id <> 16") if which == "edge" else spark.read.parquet(f"{edge.SF_DIR}/documents.parquet")
    found = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs.repartition(5)).collect()}
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    assert sorted(found) == [d for d, _ in rows]
    for (d, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        mine = found[d]
        assert mine["n_chars"] == len(text) and mine["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        for a, b, near in ((text, new, mine["near_edited"]), (text, following, mine["near_next"])):
            a, b = plain_sketch(a), plain_sketch(b)
            assert near == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert mine["fingerprint"] == "".join(f"{h:016x}" for h in sorted(plain_sketch(text)))


def test_sketches_estimate_and_merge():
    rng = random.Random(1)
    words = [f"w{rng.randrange(5000)}" for _ in range(9000)]
    whole, part, other = " ".join(words), " ".join(words[2000:2600]), " ".join(f"v{i}" for i in range(500))
    a, b, c = (fingerprints.sketch(t) for t in (whole, part, other))
    assert fingerprints.containment(b, a) == 1.0 and fingerprints.containment(c, a) == 0.0
    assert abs(fingerprints.likeness(a, b) - 596 / 8996) < 0.02
    half = fingerprints.sketch(" ".join(words[:4500])), fingerprints.sketch(" ".join(words[4496:]))
    assert (fingerprints.merge(*half) == a).all()
    assert fingerprints.likeness(fingerprints.sketch(""), fingerprints.sketch(" \n")) == 1.0
    assert len(fingerprints.sketch("one two")) == 1


def test_containment_is_unknown_for_a_sketch_above_the_threshold(spark):
    small = next(t for t in (f"note {i}" for i in range(99)) if not fingerprints.below(fingerprints.sketch(t)))
    docs = spark.createDataFrame([(1, small), (2, edge.prose(1, 400))], "doc_id long, text string")
    found = {r["doc_id"]: r["contained"] for r in fingerprints.compare_with_next(docs).collect()}
    assert found[1] is None and 0 <= found[2] <= 1


def test_fingerprint_edge_cases(spark):
    docs = edge.documents(spark)
    assert fingerprints.compare_with_next(docs).count() == len(edge.rows())
    assert fingerprints.compare_with_next(docs.limit(0)).count() == 0
    one = fingerprints.compare_with_next(docs.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    prints = {}
    for r in fingerprints.sketch_documents(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[0] == prints[1] and prints[3] == prints[4] == prints[5] == {""}
