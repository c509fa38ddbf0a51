"""Importance resampling, the audit of filters, and token counts, each against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import edge
import numpy as np
import pytest
from oracle import compare, connect
from tokenizers import Tokenizer

from framegate.llm import audit, resampling, tokens
from framegate.llm.queries import ORACLES, QUERIES, tokenizer_json

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def vocabulary():
    return tokenizer_json("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_filter_audit"])
def test_against_sql(spark, name):
    assert compare(QUERIES[name](spark, edge.SF_DIR), connect(edge.SF_DIR), ORACLES[name]).startswith("EXACT")


def plain_features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain_resample(docs, target, percent, min_words):
    raw, wanted = Counter(), Counter()
    for _, text in docs:
        raw.update(plain_features(text)[1])
    for text in target:
        wanted.update(plain_features(text)[1])
    s, t = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10000) / ((n + 1) * (t + 10000)))) for b, n in raw.items()}
    rows, able = [], []
    for doc, text in docs:
        words, features = plain_features(text)
        weight = sum(gain[b] for b in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, len(features), weight, score))
        if len(words) >= min_words:
            able.append((-score, math.inf if doc is None else doc, len(rows) - 1))
    ranks = {i: r + 1 for r, (_, _, i) in enumerate(sorted(able)[: percent * len(able) // 100])}
    return [(*row, ranks.get(i)) for i, row in enumerate(rows)]


def test_resampling_edge_cases(spark):
    data = edge.rows() + [edge.rows()[0]] * 7
    docs = edge.documents(spark, data)
    target = spark.createDataFrame([(edge.prose(5, 80), "x"), (None, "y"), ("", "z"), ("MIT License", "w")], "text string, score string")
    pairs, texts = [(r[0], r[1]) for r in data], [r["text"] for r in target.collect()]
    for percent, least, chunk, few in ((25, 20, 1 << 20, 1 << 12), (60, 1, 3, 1), (100, 0, 4, 2), (50, 20, 2, 1), (0, 20, 2, 1)):
        found = resampling.resample(docs.repartition(3), target, percent, least, chunk=chunk, few=few)
        assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert Counter(tuple(r) for r in found.collect()) == Counter(plain_resample(pairs, texts, percent, least))
    nothing = resampling.resample(docs, target.limit(0))
    assert Counter(tuple(r) for r in nothing.collect()) == Counter(plain_resample(pairs, [], 25, 20))
    assert resampling.resample(docs.limit(0), target).count() == 0


def test_features_in_parts_of_any_size():
    rng = random.Random(3)
    parts = ["a", "b", "é", "x" * 60, " ", " ", "  ", "\n", "!", "word", "Two", "日" * 30]
    for _ in range(100):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 5))]
        for size in (5, 40, 4 << 20):
            found, words = [[] for _ in texts], np.zeros(len(texts), int)
            for of, buckets, n in resampling.feature_buckets(texts, size=size):
                words += n
                for i, b in zip(of.tolist(), buckets.tolist()):
                    found[i].append(b)
            for text, got, n in zip(texts, found, words.tolist()):
                plain = plain_features(text)
                assert sorted(got) == sorted(plain[1]) and n == len(plain[0])


def test_joined_checksums():
    rng = random.Random(8)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 5, 47, 48, 49, 200]))) for _ in range(300)]
    first = np.array([zlib.crc32(w) for w in words[::-1]], np.uint32)
    second = np.array([zlib.crc32(w) for w in words], np.uint32)
    got = resampling.joined_crc(first, second, np.array(list(map(len, words))), words, np.arange(300))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(words[::-1], words)]


@pytest.mark.parametrize("ties", [1, 5, 4000])
def test_cutoff_is_exact_and_rounds_are_few(spark, monkeypatch, ties):
    rng = random.Random(ties)
    rows = [(rng.randrange(4000 // ties), rng.randrange(50), i) for i in range(4000)]
    keys = spark.createDataFrame(rows, "score long, id long, row long").repartition(7)
    ordered = sorted(rows, key=lambda r: (-r[0], r[1], r[2]))
    rounds, medians = [], resampling._medians

    def counted(*args):
        rounds.append(1)
        return medians(*args)

    monkeypatch.setattr(resampling, "_medians", counted)
    for k in (1, 2, 1000, 3999, 4000):
        rounds.clear()
        assert tuple(resampling.cutoff(keys, k, chunk=100, few=4)) == ordered[k - 1]
        assert len(rounds) <= 2 + math.log(4000) / math.log(4 / 3)


def plain_audit(rows, labels):
    """rows: (doc_id, text, source); a dict of (part, order, step) to counts."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for doc, text, _ in rows:
        key = math.inf if doc is None else doc
        least[text or ""] = min(key, least.get(text or "", math.inf))
    judged = []
    for doc, text, source in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": (math.inf if doc is None else doc) > least[text],
        }
        judged.append((source or "", {f for f, bad in fails.items() if bad}, doc in good, doc in toxic))
    out = {}
    for part in {p for p, *_ in judged}:
        own = [j for j in judged if j[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [j for j in left if f in j[1]]
                left = [j for j in left if f not in j[1]]
                failing = sum(f in j[1] for j in own)
                alone = sum(j[1] == {f} for j in own)
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(j[2] for j in gone), sum(j[3] for j in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_audit_edge_cases(spark):
    odd = [(30, "A $ B"), (31, "A $ B"), (31, "A $ B"), (None, "A $ B"), (29, "SHOUT " * 60), (28, edge.prose(9, 70)), (27, edge.prose(9, 70))]
    data = edge.rows() + [(d, t, None, s, None, *["clash"] * 8) for (d, t), s in zip(odd, ["a", "a", "b", None, "", "c", "c"])]
    labels = [(0, 1, 0), (0, 0, 1), (13, 1, 1), (None, 1, 1), (27, 1, None), (28, 1, 1), (30, None, 1), (99, 1, 1)]
    marks = spark.createDataFrame([(*row, "clash", "clash") for row in labels], "doc_id long, quality int, toxic int, source string, text string")
    docs = edge.documents(spark, data)
    found = audit.audit_filters(docs.repartition(3), marks)
    expected = plain_audit([(r[0], r[1], r[3]) for r in data], labels)
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in found.collect()} == expected
    assert found.count() == len(expected) == 600 * len({r[3] or "" for r in data})
    assert audit.audit_filters(docs.limit(0), marks).count() == 0
    bare = audit.audit_filters(docs, marks.limit(0)).collect()
    assert len(bare) == len(expected) and not any(r["good_lost"] or r["toxic_lost"] for r in bare)


def test_lehmer_ranks_and_intervals():
    assert [audit.lehmer_rank(p) for p in audit.orders()] == list(range(120))
    places = {}
    for mask, step, f, lo, hi in audit.intervals():
        for r in range(lo, hi):
            assert (mask, r) not in places
            places[mask, r] = step, f
    for mask in range(1, 32):
        for r, order in enumerate(audit.orders()):
            step = next(i for i, f in enumerate(order) if mask >> f & 1)
            assert places[mask, r] == (step + 1, order[step])


def test_audit_plan_has_no_hot_window(spark):
    """A group of copies meets as a row per (part, label), not as its documents."""
    docs = spark.createDataFrame([(i, "same", "s") for i in range(3000)], "doc_id long, text string, source string")
    found = audit.counted_masks(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {(r["mask"], r["n"]) for r in found} == {(1, 1), (17, 2999)}


def test_token_counts_equal_the_library(spark, vocabulary):
    tokenizer = Tokenizer.from_str(vocabulary)
    data = edge.rows() + [(40, "<|endoftext|>a<|startoftext|> <|endoftext|", *edge.rows()[0][2:]), (41, "DON'T 'Twas ''s" * 9, *edge.rows()[0][2:])]
    found = edge.collected(tokens.token_counts(edge.documents(spark, data).repartition(3), vocabulary, limit=100))
    expected = Counter()
    for doc, text, *_ in data:
        n = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected[doc, len((text or "").encode()), n, n > 100] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == expected
    assert tokens.token_counts(edge.documents(spark).limit(0), vocabulary).count() == 0
    docs = spark.read.parquet(f"{edge.SF_DIR}/documents.parquet").collect()
    whole = {r["doc_id"]: r for r in QUERIES["op13_token_counts"](spark, edge.SF_DIR).collect()}
    for r in docs:
        assert whole[r["doc_id"]]["n_tokens"] == len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)


def test_merges_of_random_and_very_long_words(vocabulary):
    tokenizer, counter, rng = Tokenizer.from_str(vocabulary), tokens.Counter(vocabulary), random.Random(1)
    parts = " |  |a|b|T|é|日|\n|\t|\xa0|\x1c|'s|'LL|!|1|٣|😀|　|\x85|ß|İ|ΑΣ|é|́|ſ|word|aaa|''| |ﬁ|​|²|Ⅷ|\x00".split("|")
    parts += ["<|endoftext|>", "<|startoftext|>", "<|", "|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (100, 511, 512, 513, 5000)]
    texts += ["a" * n for n in (511, 512, 513, 514, 1001)] + ["!" * 3000, "日本語" * 700, "=-" * 900]
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        expected = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in part]
        assert counter.count([t.encode() for t in part]) == expected
    merges = counter.merges
    for word in (b"aaaa", b"abracadabra", b"the" * 30, bytes(rng.choice(b"abcde") for _ in range(300))):
        assert merges._count_long(word) == merges._count_rounds([word])[0]


def test_a_megabyte_without_spaces_takes_a_linear_time(vocabulary):
    counter, rng = tokens.Counter(vocabulary), random.Random(2)
    word = bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20))
    assert 0 < counter.count([word])[0] < len(word)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.Merges(tokenizer_json())
