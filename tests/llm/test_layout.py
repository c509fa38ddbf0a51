"""Packing, sharding, mixing and the pipeline."""

import math
import random
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import edge
import numpy as np
import pytest
from tokenizers import Tokenizer

from framegate.llm import mixing, packing, sharding
from framegate.llm.queries import QUERIES, tokenizer_json

TABLES = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_str(tokenizer_json())


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    encoder, rng = packing.Encoder(tokenizer_json()), random.Random(1)
    assert encoder.rest.ranks is not None
    parts = [" ", "  ", "a", "b", "T", "é", "日", "\n", "\t", "\xa0", "\x1c", "'s", "!", "1", "٣", "<|endoftext|>", "😀", "　", "\x85", "ß", ".", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    for text in texts + [r[1] or "" for r in edge.rows()]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def check_packing(rows, docs, tokenizer, capacity):
    """Every id of every document once, in order; sequences without gaps or overlaps."""
    expected = Counter()
    for doc, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % capacity or capacity
        cuts = [0, *range(head, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected[doc, piece, a, tuple(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= capacity
    return len(sequences), -(-sum(r["length"] for r in rows) // capacity)


@pytest.mark.parametrize("which", ["edge", "table"])
def test_packing_round_trip(spark, tokenizer, which):
    docs = edge.documents(spark) if which == "edge" else spark.read.parquet(f"{edge.SF_DIR}/documents.parquet")
    pairs = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for capacity in (1024, 64):
        rows = packing.pack(docs.repartition(3), tokenizer_json(), capacity).collect()
        used, least = check_packing(rows, pairs, tokenizer, capacity)
        assert used <= least * 1.02 + 1
    assert packing.pack(docs.limit(0), tokenizer_json()).count() == 0


def fewest(items, capacity):
    """Fewest bins by search, for a few items."""
    items = sorted(items, reverse=True)
    best = len(items)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= items[k]}.values():
            rooms[i] -= items[k]
            place(k + 1, rooms)
            rooms[i] += items[k]
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best


def test_plan_holds_every_item_and_reduction_keeps_the_optimum():
    rng = random.Random(4)
    for _ in range(300):
        capacity = rng.choice([10, 17, 30])
        low = rng.choice([1, 3, 5])
        items = [rng.randint(low, capacity) for _ in range(rng.randint(1, 11))]
        counts = Counter(items)
        patterns = packing.plan(dict(counts), capacity)
        held = Counter()
        for bin_, n in patterns:
            assert sum(bin_) <= capacity and n > 0
            held.update({s: k * n for s, k in Counter(bin_).items()})
        assert held == counts
        sizes = packing._Sizes(dict(counts))
        fixed = packing.reduce_dominated(sizes, capacity)
        rest = [s for s, n in sizes.count.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(items, capacity)
        assert sum(n for _, n in patterns) <= math.ceil(1.25 * fewest(items, capacity)) + 1


def test_plan_does_not_grow_with_the_number_of_items():
    rng = random.Random(9)
    counts = {s: rng.randint(0, 10**9) for s in range(1, 1025)}
    patterns = packing.plan(counts, 1024)
    assert len(patterns) < 20_000
    total = sum(s * n for s, n in counts.items())
    assert sum(n for _, n in patterns) <= 1.03 * total / 1024 + 1


def check_sharding(found, docs, shards):
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((r["doc_id"], r["text"]) for r in docs)
    slots = defaultdict(list)
    owner = {}
    for r in found:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        assert r["grown_shard"] in (r["shard"], shards)
        assert owner.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_sharding_law(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    rows = docs.collect()
    found = sharding.shard_documents(docs, bucket_bytes=20_000).collect()
    check_sharding(found, rows, 16)
    counts = Counter(r["shard"] for r in found)
    assert len(counts) == 16 and max(counts.values()) < 2 * len(rows) / 16
    assert 0 < sum(r["grown_shard"] == 16 for r in found) < 2 * len(rows) / 17
    again = sharding.shard_documents(docs, bucket_bytes=20_000).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in found} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}
    order = [r["doc_id"] for r in sorted(found, key=lambda r: r["slot"]) if r["shard"] == 0]
    down = sum(a > b for a, b in zip(order, order[1:]))
    assert 0.25 * len(order) < down < 0.75 * len(order)


def test_sharding_edge_cases(spark, tmp_path):
    data = edge.rows() + [edge.rows()[0]] * 60
    docs = edge.documents(spark, data)
    found = sharding.shard_documents(docs, shards=3, bucket_bytes=500)
    assert set(docs.columns) <= set(found.columns) and found.schema["slot"].dataType.simpleString() == "bigint"
    check_sharding(found.collect(), docs.collect(), 3)
    sharding.write_shards(found, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(data)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    assert {r["shard"] for r in sharding.shard_documents(docs, shards=1).collect()} == {0}


def test_sharding_keeps_columns_of_any_name(spark):
    names = ["draw", "bucket", "pos", "base", "row", "place", "part", "parts", "cell", "one", "rows", "n", "bytes", "a.b", "Slot"]
    data = [(i, f"text {i}", *(f"{n}{i}" for n in names)) for i in range(50)]
    docs = spark.createDataFrame(data, ["doc_id", "text", *names])
    found = sharding.shard_documents(docs, shards=2, bucket_bytes=100)
    assert found.columns == ["doc_id", "text", *names[:-1], "size", "shard", "slot", "grown_shard"]
    assert sorted(tuple(r)[: len(names) + 1] for r in found.collect()) == [r[:-1] for r in data]


def test_sharding_hangs_on_content_and_splits_crowds(spark):
    rows = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    places = []
    for parts in (1, 7):
        found = sharding.shard_documents(rows.repartition(parts), bucket_bytes=20_000)
        places.append({(r["doc_id"], r["shard"], r["slot"]) for r in found.collect()})
    assert places[0] == places[1]
    crowd = spark.createDataFrame([(7, "again and again")] * 3000, "doc_id long, text string")
    found = sharding.shard_documents(crowd, bucket_bytes=1000)
    assert sorted(r["slot"] for r in found.collect()) == list(range(3000))


def test_sharding_is_native(spark):
    plan = QUERIES["op10_sharding"](spark, TABLES)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def sizes_table(spark, sizes):
    return spark.createDataFrame(list(sizes.items()), "source string, n long")


def test_exponent_meets_the_targets(spark):
    sizes = {"a": 1000, "b": 100, "c": 10, "d": 10}
    table = sizes_table(spark, sizes)

    def entropy(t):
        w = np.array(list(sizes.values()), float) ** t
        w /= w.sum()
        return -(w * np.log(w)).sum()

    weights, t = mixing.source_weights(table, max_repeats=2.0)
    assert (1000 / 10) ** (1 - t) == pytest.approx(2.0, abs=1e-9)
    rows = {r["source"]: r for r in weights.collect()}
    assert sum(r["weight"] for r in rows.values()) == pytest.approx(1)
    assert rows["a"]["repeats"] == 1.0 and rows["c"]["repeats"] == pytest.approx(2.0)
    target = 0.7 * entropy(0) + 0.3 * entropy(1)
    _, t = mixing.source_weights(table, entropy=target, max_repeats=None)
    assert entropy(t) == pytest.approx(target, abs=1e-9)
    assert mixing.source_weights(table, entropy=0.0, max_repeats=None)[1] == 1.0
    assert mixing.source_weights(table, max_repeats=1000.0)[1] == 0.0
    assert mixing.source_weights(sizes_table(spark, {"a": 5}))[1] == 0.0


def plain_tokens(text):
    return len((text or "").encode().split()) + 1


def test_mixing_draws_every_document_to_budget(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").where("source <> 'src1' OR doc_id % 3 = 0")
    rows = docs.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += plain_tokens(r["text"])
    block = 50_000
    drawn = mixing.mix(docs, block_tokens=block, columns=("doc_id", "source", "text")).collect()
    epochs = defaultdict(Counter)
    for r in drawn:
        assert r["__tokens"] == plain_tokens(r["text"])
        epochs[r["source"], r["__epoch"]][r["doc_id"]] += 1
    top = max(size.values())
    t = 1 - math.log(2) / math.log(top / min(size.values()))
    for source, n in size.items():
        own = {r["doc_id"] for r in rows if r["source"] == source}
        assert set(epochs[source, 0]) == own and all(v == 1 for v in epochs[source, 0].values())
        repeats = (top / n) ** (1 - t)
        got = sum(r["__tokens"] for r in drawn if r["source"] == source)
        longest = max(plain_tokens(r["text"]) for r in rows if r["source"] == source)
        assert n * repeats - 1 <= got <= n * repeats + longest
    blocks = defaultdict(list)
    for r in drawn:
        blocks[r["__block"]].append(r)
    weights = {s: n**t for s, n in size.items()}
    for members in blocks.values():
        assert sorted(r["__slot"] for r in members) == list(range(len(members)))
    middle = [k for k in blocks if k < max(blocks) - 1]
    for s in size:
        share = sum(r["__tokens"] for k in middle for r in blocks[k] if r["source"] == s) / (block * max(1, len(middle)))
        assert share == pytest.approx(weights[s] / sum(weights.values()), abs=0.05)


def test_mixing_edge_cases(spark):
    docs = edge.documents(spark, edge.rows() + [edge.rows()[0]] * 40)
    drawn = mixing.mix(docs, columns=tuple(docs.columns))
    assert drawn.columns[: len(docs.columns)] == docs.columns
    first = drawn.where("__epoch = 0")
    assert Counter(r["doc_id"] for r in first.collect()) == Counter(r["doc_id"] for r in docs.collect())
    assert drawn.count() == mixing.mix(docs).count()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pipeline_stages_hand_on_documents(spark, tokenizer):
    from test_near import plain_alike, plain_repeats

    docs = spark.read.parquet(f"{edge.SF_DIR}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for _, function in corpus_pipeline.STAGES[:-1]:
        tables.append(function(spark, tables[-1], edge.SF_DIR).cache())
        assert tables[-1].columns == columns
    first, near, cut, mixed = ([(r["doc_id"], r["text"]) for r in t.collect()] for t in tables[1:])
    assert sorted(first) == sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert sorted(d for d, _ in near) == plain_alike(first) and len(near) < len(first)
    expected = {d: k for d, n, gone, k in plain_repeats(near) if not n or gone < n}
    assert {d: b" ".join(t.encode().split()) for d, t in cut} == expected and len(cut) == len(expected)
    assert set(mixed) == set(cut) and len(mixed) > len(cut)
    packed = corpus_pipeline.STAGES[-1][1](spark, tables[-1], edge.SF_DIR)
    whole = packing.pack(tables[-1], tokenizer_json()).collect()
    used, least = check_packing(whole, mixed, tokenizer, 1024)
    rows = packed.collect()
    assert len(rows) == len(whole) and len({r["sequence_id"] for r in rows}) == used <= least * 1.02 + 1
    result = corpus_pipeline.run(spark, edge.SF_DIR).collect()
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in result) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)


def test_pipeline_edge_cases(spark):
    for docs in (edge.documents(spark), edge.documents(spark).limit(0)):
        left = docs
        for _, function in corpus_pipeline.STAGES[:-1]:
            left = function(spark, left, edge.SF_DIR)
            assert left.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, left, edge.SF_DIR).collect()
        kept = {r["doc_id"] for r in packed}
        assert not kept & {3, 4, 5, 17} and (not docs.count() or {0, 6, 7, 8, 11} <= kept)
