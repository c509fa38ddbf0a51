"""Near-duplicate operators against brute force."""

import itertools
import math
import random
import tracemalloc

import edge
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framegate.llm import alike, simhash, substring, vectors
from framegate.llm.common import components
from framegate.llm.queries import QUERIES


def plain_print(text, words=3):
    tokens = (text or "").encode().lower().split()
    shingles = [b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows):
    prints = [(d, plain_print(t)) for d, t in rows]
    distinct = sorted({p for _, p in prints})
    linked = {p: [q for q in distinct if (p ^ q).bit_count() <= 3] for p in distinct}
    roots = edge.components(distinct, linked)
    least = {}
    for d, p in prints:
        if d is not None:
            least[roots[p]] = min(d, least.get(roots[p], d))
    return sorted(((d, f"{p:016x}", least.get(roots[p])) for d, p in prints), key=repr)


@pytest.mark.parametrize("which", ["edge", "table"])
def test_simhash_against_all_pairs(spark, which):
    docs = edge.documents(spark) if which == "edge" else spark.read.parquet(f"{edge.SF_DIR}/documents.parquet")
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_print().alias("f"), "component_id")
    expected = plain_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected


def plain_alike(rows, similar=0.8):
    """The smallest doc_id of each component of all pairs at ``similar`` or more."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    linked = {i: [] for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j]):
            linked[i].append(j)
            linked[j].append(i)
    least = {}
    for i, r in edge.components(range(len(rows)), linked).items():
        least[r] = min(rows[i][0], least.get(r, math.inf))
    return sorted(least.values())


@pytest.mark.parametrize("chunk", [8, 1024])
def test_pipeline_near_duplicates_against_all_jaccard_pairs(spark, chunk):
    """Table rows, edited copies around the threshold, chains of edits, a crowd of copies of one text, and a crowd that is
    similar, but not linked."""
    rng = random.Random(5)
    table = spark.read.parquet(f"{edge.SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in table if r["text"]]
    start = 1 + max(d for d, _ in rows)

    def edit(words, n):
        words = list(words)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"edit{rng.random()}"
        return words

    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    texts = [edit(base, rng.randint(0, 6)) for _ in range(60)]
    for _ in range(40):
        chain = [f"c{rng.randrange(5000)}" for _ in range(120)]
        for _ in range(3):
            texts.append(chain)
            chain = edit(chain, rng.randint(1, 4))
    other = [f"o{rng.randrange(5000)}" for _ in range(200)]
    texts += [edit(other, rng.randint(7, 10)) for _ in range(60)]
    rows += [(start + i, " ".join(w)) for i, w in enumerate(texts)] + [(start + 900, ""), (start + 901, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = plain_alike(rows)
    assert sorted(r["doc_id"] for r in alike.keep_one(docs, chunk=chunk).collect()) == expected
    assert alike.keep_one(docs.limit(0)).count() == 0


def test_common_shingles_and_forest():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]]
    for columns in (7, 2048):
        assert alike.common_shingles(sets[:10], sets[10:], columns).tolist() == expected
    assert alike.common_shingles([], sets).shape == (0, 30)
    for n in (2, 5, 40):
        linked = rng.random((n, n)) < 1.2 / n
        linked |= linked.T
        everyone, root = np.arange(n), rng.integers(0, n, n)
        links = alike.forest(linked, everyone, everyone, root)
        both = {i: np.flatnonzero(linked[i]).tolist() + np.flatnonzero(root == root[i]).tolist() for i in range(n)}
        tree = {i: [j for p in links for j in p if i in p] + np.flatnonzero(root == root[i]).tolist() for i in range(n)}
        assert edge.components(range(n), tree) == edge.components(range(n), both)
        assert len(links) <= len(set(root.tolist())) - 1 and all(linked[i, j] for i, j in links)


def test_simhash_links_lose_nothing(spark):
    """Random fingerprints with planted neighbours, and one crowded cluster that is dealt into chunk pairs."""
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(300)}
    for p in list(prints)[:60]:
        prints.add(p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))))
    centre = rng.getrandbits(64)
    prints |= {centre ^ sum(1 << b for b in rng.sample(range(40), rng.randint(1, 3))) for _ in range(200)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    table = spark.createDataFrame([(s,) for s in signed], "print long")
    expected = edge.components(prints, {p: [q for q in prints if (p ^ q).bit_count() <= 3] for p in prints})
    for chunk in (16, 4096):
        links = simhash.links(table, chunk=chunk).cache()
        assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links.collect())
        roots = {r["node"]: r["root"] for r in components(links).collect()}
        groups = {}
        for p, s in zip(prints, signed):
            groups.setdefault(roots.get(s, s), set()).add(p)
        wanted = {}
        for p, r in expected.items():
            wanted.setdefault(r, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_pivot_filter_keeps_every_close_pair():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, 200, np.uint64, endpoint=False)
    b = np.r_[a[:50] ^ np.uint64(5), a[50:100], rng.integers(0, 1 << 64, 100, np.uint64, endpoint=False)]
    i, j = simhash.close_pairs(a, b, simhash.references(), 3)
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= 3
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    data = [r for r in edge.rows() if r[1] != "another text"]
    docs = edge.documents(spark, data)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {c for _, _, c in plain_components([(r[0], r[1]) for r in data])}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(groups)
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 501), (501, 500), (7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 160)), [500, 501]]


def plain_repeats(rows, window=50):
    first = {}
    docs = [(math.inf if d is None else d, (t or "").encode().split()) for d, t in rows]
    for d, words in docs:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, math.inf), d)
    out = []
    for (d, words), (real, _) in zip(docs, rows):
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((real, len(words), len(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which, variants", [("edge", 256), ("edge", 1), ("table", 256), ("table", 2)])
def test_repeats_against_all_windows(spark, which, variants):
    docs = edge.documents(spark) if which == "edge" else spark.read.parquet(f"{edge.SF_DIR}/documents.parquet")
    found = substring.remove_repeats(docs, variants=variants).collect()
    mine = sorted(((r["doc_id"], r["n_words"], r["n_removed"], b" ".join(r["left"].encode().split())) for r in found), key=repr)
    expected = plain_repeats([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert mine == expected
    assert sum(n for _, _, n, _ in expected) > 0


def test_repeats_in_many_contexts_and_long_texts(spark, monkeypatch):
    """A passage between other words in every document, a periodic text, and a text longer than one step."""
    monkeypatch.setattr(substring, "STEP", 256)
    substring._POWERS.clear()
    passage = edge.prose(70, 57)
    data = [(i, f"{edge.prose(1000 + i, 30)} {passage} {edge.prose(2000 + i, 30)}") for i in range(40)]
    data += [(50, "a b c " * 300), (51, "b c a " * 100), (52, edge.prose(9, 1500)), (53, edge.prose(8, 90) + " " + edge.prose(9, 1500)[200:4000])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for variants in (5, 256):
        found = substring.remove_repeats(docs, variants=variants).collect()
        mine = sorted(((r["doc_id"], r["n_words"], r["n_removed"], b" ".join(r["left"].encode().split())) for r in found), key=repr)
        assert mine == plain_repeats(data)
    substring._POWERS.clear()


def test_automaton_finds_the_first_document():
    rng = random.Random(2)
    texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    automaton = substring.SuffixAutomaton()
    for doc, words in sorted(enumerate(texts), key=lambda x: -x[0]):
        automaton.add(words, doc)
    automaton.settle()
    for words in texts + [[b"a", b"z", b"b", b"a", b"c", b"c", b"b"]]:
        for i, first in enumerate(automaton.first_documents(words, 4)):
            part = words[i : i + 4]
            holders = [d for d, t in enumerate(texts) if any(t[k : k + 4] == part for k in range(len(t)))]
            assert first == (min(holders) if holders else np.iinfo(np.int64).max)


def test_kept_rows_keep_columns_and_spacing(spark):
    docs = edge.documents(spark)
    kept = substring.keep_rest(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    rows = edge.collected(kept)
    gone = {d for d, n, r, _ in plain_repeats([(r[0], r[1]) for r in edge.rows()]) if n and n == r}
    assert len(rows) == len(edge.rows()) - sum(1 for r in plain_repeats([(r[0], r[1]) for r in edge.rows()]) if r[1] and r[1] == r[2])
    assert 10 in gone
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[18]["text"] == " lead and trail " and by_id[4]["text"] is None
    assert by_id[9]["n_chars"] == len(by_id[9]["text"])
    assert substring.keep_rest(docs.limit(0)).count() == 0


def plain_vectors(rows, cosine=0.93):
    ok = [
        v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows
    ]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if o else None for (_, v, _), o in zip(rows, ok)]
    linked = {i: [] for i in range(len(rows))}
    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine:
            linked[i].append(j)
            linked[j].append(i)
    roots = edge.components(range(len(rows)), linked)
    least = {}
    for i, r in roots.items():
        least[r] = min(least.get(r, math.inf), rows[i][0])
    return sorted((rows[i][0], len(linked[i]), least[roots[i]], rows[i][0] == least[roots[i]]) for i in range(len(rows)))


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist(), i % 3) for i in range(300)]
    for i in range(300, 420):
        base = np.array(rows[rng.integers(0, 40)][1])
        rows.append((i, (base + rng.normal(size=16) * 0.2).tolist(), int(rng.integers(0, 3))))
    rows += [(500, rows[3][1], 0), (501, rows[3][1], 0), (502, [2 * x for x in rows[3][1]], 0), (503, rows[3][1], None)]
    rows += [(504, None, 0), (505, [0.0] * 16, 0), (506, [float("nan")] * 16, 0), (507, [1.0, None] * 8, 0)]
    rows += [(508, [float("inf")] + [1.0] * 15, 0), (509, [1.0, 2.0], 0), (510, [1.0, 2.0], 0), (511, [], 0), (3, rows[3][1], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, points string")
    for nearest in (7, 16):
        found = sorted(tuple(r) for r in vectors.near_vectors(table, pivots=32, nearest=nearest).collect())
        expected = plain_vectors(rows)
        assert [r[0] for r in found] == [r[0] for r in expected]
        links, all_links = sum(r[1] for r in found), sum(r[1] for r in expected)
        assert links <= all_links and links >= 0.9 * all_links
        assert all(a[1] <= b[1] for a, b in zip(found, expected))
        if nearest == 16:
            assert found == expected
    assert vectors.near_vectors(table.limit(0)).count() == 0


def test_vector_recall_at_the_threshold(spark):
    """Pairs whose cosine is barely enough are the hardest; nine in ten must be found."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(10, 64))
    base = centres[rng.integers(0, 10, 1000)] + rng.normal(size=(1000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = 0.932 * base + math.sqrt(1 - 0.932**2) * noise
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.r_[base, near])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = vectors.near_vectors(table).agg(F.sum("n_links")).first()[0]
    every = np.r_[base, near] @ np.r_[base, near].T
    assert found >= 0.9 * ((every >= 0.93).sum() - len(rows))


def test_vector_recall_in_a_group_of_near_copies(spark):
    """A third of the rows are distinct near copies of one vector; nine in ten of their links must be found."""
    rng = np.random.default_rng(21)
    centre = rng.normal(size=64)
    copies = centre + 0.25 * np.linalg.norm(centre) * rng.normal(size=(500, 64)) / 8
    every = np.r_[rng.normal(size=(1000, 64)), copies]
    every /= np.linalg.norm(every, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(every)], "vec_id long, embedding array<double>, label int")
    found = vectors.near_vectors(table).agg(F.sum("n_links"), F.sum(F.col("kept").cast("int"))).first()
    all_links = int((every @ every.T >= 0.93).sum()) - len(every)
    assert 10_000 < all_links and 0.9 * all_links <= found[0] <= all_links
    least, linked = {}, {i: np.flatnonzero(r).tolist() for i, r in enumerate(every @ every.T >= 0.93)}
    for i, r in edge.components(range(len(every)), linked).items():
        least.setdefault(r, i)
    assert found[1] == len(least)


def test_few_reference_points_lie_apart():
    """Two dimensions have room for a few points only; the numbers that all vectors share stand for the others."""
    points = vectors.reference_points([[1.0, 0.0], [0.99, 0.1], [1.0, 0.05]])[2]
    assert ((points @ points.T)[~np.eye(len(points), dtype=bool)] < vectors.APART).all() and len(points) < vectors.PIVOTS
    near = vectors.nearest_points(np.array([[1.0, 0.0], [-1.0, 0.0]]), points[:3])
    assert near.shape == (2, 7) and (near[:, 3:] == [-1, -2, -3, -4]).all()


def test_queries_return_one_row_per_row(spark):
    n = spark.read.parquet(f"{edge.SF_DIR}/documents.parquet").count()
    assert QUERIES["op5_simhash_near_dedup"](spark, edge.SF_DIR).count() == n
    assert QUERIES["op9_substring_dedup"](spark, edge.SF_DIR).count() == n


def test_a_reference_shard_stays_small():
    tracemalloc.start()
    automaton = substring.SuffixAutomaton()
    words = [b"w%d" % (i * 7919 % 30011) for i in range(substring.SHARD_WORDS)]
    for doc in range(0, len(words), 63):
        automaton.add(words[doc : doc + 63], doc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
