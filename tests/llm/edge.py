"""Small tables with the awkward cases, and helpers."""

import random

from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
    + [T.StructField(n, T.StringType()) for n in ("id", "th", "print", "root", "part", "length", "slot", "n")]
)
WORDS = "the of and a in to house tree river stone light door hand word time year day man world life part".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


def rows() -> list[tuple]:
    passage = prose(7, 120)
    texts = [
        (0, prose(1, 300)), (1, prose(1, 300)), (2, prose(1, 300) + " more"), (3, ""), (4, None), (5, "   \n\t "), (6, "one"),
        (7, "two words"), (8, prose(2, 40) + " " + passage + " " + prose(3, 30)), (9, prose(4, 55) + "\n" + passage),
        (10, passage), (11, prose(5, 6000)), (12, "Ünïcode 漢字 　 text\xa0here <|endoftext|> 1 2 3  \n\n x"),
        (13, "word " * 200), (14, "Word " * 200), (15, "Released under the MIT License. MIT license MIT License"),
        (16, "Relaesed under the MTI License"), (16, "Relaesed under the MTI License"), (16, "another text"),
        (17, "12 34 !!"), (None, prose(1, 300)), (None, passage), (18, " lead and trail "), (19, "CC BY cc-by (CC) BY"),
        (20, passage[:300] + "x" + passage[300:]),
    ]
    langs, sources = ["en", "de", None], ["a", "a", "b", None, ""]
    return [
        (d, t, langs[i % 3], sources[i % 5], None if i % 4 == 0 else len(t or ""), *["clash"] * 8) for i, (d, t) in enumerate(texts)
    ]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def collected(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def components(nodes, linked) -> dict:
    """Smallest reachable node by search."""
    out = {}
    for start in sorted(nodes):
        if start in out:
            continue
        stack = [start]
        while stack:
            a = stack.pop()
            if a not in out:
                out[a] = start
                stack += linked[a]
    return out
