"""Licence notices in texts: exact phrases, and short notices with a bounded number of edits.

Fuzzy search: a notice that may hold ``k`` edits is split into ``k + 1`` pieces; by the pigeonhole principle any match
with at most ``k`` edits holds one piece exactly. Exact search for the pieces locates candidate windows, and the regex
library's bounded-error matching verifies them and reports spans and edits.
"""

from __future__ import annotations

import bisect
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from framegate.llm.common import map_batches, text_or_empty

#: Phrases that are counted exactly, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices, their labels and the edits (of characters) each may hold.
NOTICES = (
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("under the apache license version", "apache", 3),
    ("released under the mit license", "mit", 3),
    ("licensed under cc by", "cc-by", 2),
    ("licensed under cc by nc", "cc-by-nc", 2),
    ("licensed under cc by sa", "cc-by-sa", 2),
    ("creative commons attribution", "cc-by", 3),
    ("mozilla public license", "mpl", 2),
    ("eclipse public license", "epl", 2),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("permission to use copy modify and or distribute", "isc", 4),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "all-rights-reserved", 2),
    ("gnu affero general public license", "agpl", 3),
    ("gnu free documentation license", "gfdl", 3),
    ("boost software license", "bsl", 2),
    ("academic free license", "afl", 2),
    ("artistic license", "artistic", 1),
    ("common development and distribution license", "cddl", 4),
    ("european union public licence", "eupl", 3),
    ("microsoft public license", "ms-pl", 2),
    ("python software foundation license", "psf", 3),
    ("do what the fuck you want to public license", "wtfpl", 4),
    ("this is free and unencumbered software", "unlicense", 3),
    ("this software is provided as is without any express or implied warranty", "zlib", 6),
    ("neither the name of the copyright holder nor the names of its contributors", "bsd-3-clause", 6),
    ("sil open font license", "ofl", 2),
    ("creative commons zero", "cc0", 2),
    ("no rights reserved", "cc0", 1),
    ("licensed under cc by nd", "cc-by-nd", 2),
)
#: Windows of a text whose results are remembered at a time, for texts that repeat themselves.
WINDOWS = 10_000
SPANS = "spans array<struct<label:string,first:long,last:long,edits:int,score:double>>"
#: Upper case to lower; everything that is no word character (0-9, a-z, beyond ASCII) to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def folded(text: str) -> str:
    """The words of a text with one space before, between and after them."""
    words = text.encode().translate(FOLD).split(b" ")
    line = b" ".join(filter(None, words)).decode()
    return f" {line} " if line else " "


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of nearly equal length, with their offsets."""
    cuts = [round(i * len(notice) / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


_KNOWN: dict[tuple, list[tuple]] = {}


def _compiled(notices: tuple[tuple[str, str, int], ...]) -> list[tuple]:
    """Pieces and pattern of every notice, made once in a task."""
    if notices not in _KNOWN:
        _KNOWN[notices] = [
            (notice, label, k, pieces(notice, k), regex.compile(f"(?be)(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}"))
            for notice, label, k in notices
        ]
    return _KNOWN[notices]


def _places(line: str, part: str) -> list[int]:
    found, at = [], line.find(part)
    while at >= 0:
        found.append(at)
        at = line.find(part, at + 1)
    return found


def exact_places(line: str, phrase: str) -> list[int]:
    """Words (from 0) at which the words of ``phrase`` start, overlaps included."""
    out, words, before = [], 0, 0
    for at in _places(line, f" {phrase} "):
        words += line.count(" ", before, at)
        before = at
        out.append(words)
    return out


def fuzzy_spans(line: str, notices: tuple[tuple[str, str, int], ...]) -> list[tuple[str, int, int, int, float]]:
    """(label, first character, end, edits, score) of the best match at every place that holds a piece of a notice.

    A piece at ``p`` with offset ``o`` means that a match starts within ``k`` of ``p - o`` and ends within ``k`` of the
    notice's length behind it, so every place is verified in a window of its own, whatever stands beside it.
    """
    out = []
    for notice, label, edits, parts, pattern in _compiled(notices):
        size, found = len(notice), {}
        known: dict[str, tuple[int, int, int] | None] = {}
        for at in sorted({p - offset for offset, part in parts for p in _places(line, part)}):
            lo = max(0, at - edits)
            window = line[lo : at + size + edits]
            if window not in known:
                match = pattern.search(window)
                if len(known) >= WINDOWS:
                    known.clear()
                known[window] = (*match.span(), sum(match.fuzzy_counts)) if match and match.end() > match.start() else None
            if (best := known[window]) is not None:
                found[lo + best[0], lo + best[1]] = best[2]
        out += [(label, lo, hi, wrong, 1 - wrong / size) for (lo, hi), wrong in found.items()]
    return sorted(out, key=lambda s: (s[1], s[2], s[0]))


def best_spans(spans: list[tuple[str, int, int, int, float]]) -> list[tuple[str, int, int, int, float]]:
    """Of matches that overlap, the one with the best score, then the longest, then the first stays."""
    kept: list[tuple[int, int]] = []
    out = []
    for span in sorted(spans, key=lambda s: (-s[4], s[1] - s[2], s[1], s[0])):
        at = bisect.bisect_left(kept, (span[1], span[2]))
        if (at and kept[at - 1][1] > span[1]) or (at < len(kept) and kept[at][0] < span[2]):
            continue
        kept.insert(at, (span[1], span[2]))
        out.append(span)
    return sorted(out, key=lambda s: s[1])


def scan(text: str, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> tuple:
    """Words, places of base phrases, smallest and largest of them, base labels, all labels, score, spans in words."""
    line = folded(text)
    n_words = line.count(" ") - 1 if len(line) > 1 else 0
    places, base = [], set()
    for phrase, label in PHRASES.items():
        if found := exact_places(line, phrase):
            places += found
            base.add(label)
    spans, words, before = [], 0, 0
    for label, lo, hi, edits, score in best_spans(fuzzy_spans(line, notices)):
        while line[lo] == " " and lo < hi - 1:
            lo += 1
        words += line.count(" ", before, lo)
        before = lo
        last = words - 1 + line.count(" ", lo, hi - (line[hi - 1] == " "))
        spans.append({"label": label, "first": words - 1, "last": last, "edits": edits, "score": score})
    labels = sorted(base | {s["label"] for s in spans})
    score = 1.0 if base else max((s["score"] for s in spans), default=0.0)
    first, last = (min(places), max(places)) if places else (None, None)
    return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(labels), score, spans


def find_licenses(docs: DataFrame, notices: tuple[tuple[str, str, int], ...] = NOTICES) -> DataFrame:
    """One row per row of ``docs``: n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` holds every match of a notice (of matches that overlap, the best): label, first and last word, edits, and
    1 - edits / length. The score is 1 with an exact phrase, else that of the best span, else 0. A null text is empty: no words, no places, empty label
    strings. Repeated rows and null ids keep their rows. Columns beside doc_id and text are left out; an empty table gives
    no rows. Texts of any length are searched whole.
    """
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(scan(t, notices) for t in batch.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    schema = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        f"score double, {SPANS}"
    )
    return map_batches(docs.select(F.col("doc_id").cast("long"), text_or_empty()), run, schema)
