"""License notices: exact seeds locate candidates, bounded-error matching verifies them."""

from __future__ import annotations

from bisect import bisect_left

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_batches, words_of

# Phrases whose exact places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Short notices that are sought with errors, and their labels.
NOTICES = (
    ("under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("apache license version 2", "apache-2"),
    ("licensed under the apache license", "apache"),
    ("gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu library general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("gnu free documentation license", "gfdl"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("european union public licence", "eupl"),
    ("common development and distribution license", "cddl"),
    ("microsoft public license", "ms-pl"),
    ("boost software license", "bsl-1"),
    ("artistic license 2 0", "artistic-2"),
    ("academic free license", "afl"),
    ("open software license", "osl"),
    ("sil open font license", "ofl"),
    ("server side public license", "sspl"),
    ("business source license", "busl"),
    ("bsd 2 clause license", "bsd-2-clause"),
    ("bsd 3 clause license", "bsd-3-clause"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("permission to use copy modify and or distribute this software", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution noncommercial sharealike", "cc-by-nc-sa"),
    ("creative commons attribution noncommercial noderivatives", "cc-by-nc-nd"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noderivatives", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("all rights reserved", "all-rights-reserved"),
)
#: Characters that an edit costs when overlapping matches are weighed by the characters of their phrases.
EDIT_COST = 4


class Notices:
    """Notices with at most ``errors(phrase)`` character edits: one for every ``per`` characters, at most ``most``.

    A phrase with e errors is cut into e + 1 pieces; by the pigeonhole principle one of them stands unchanged in any
    match, so the pieces are the seeds of one search automaton and no match is lost. Numbers in a phrase tell licenses
    apart, so they must stand unchanged.
    """

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, per: int = 10, most: int = 3) -> None:
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (phrase, label) in enumerate(notices):
            errors = min(most, len(phrase) // per)
            # A match starts and ends at word bounds.
            pattern = regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(phrase)}){{e<={errors}}}(?![^ ])")
            self.notices.append((phrase, label, errors, pattern))
            cuts = [len(phrase) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(phrase[a:b], []).append((k, a))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """(start, end, label, edits, phrase length) of all matches in a text of words with one blank between them."""
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (n, uses) in self.seeds.iter(text):
            for k, at in uses:
                phrase, _, errors, _ = self.notices[k]
                start = end + 1 - n - at
                lo, hi = max(0, start - errors), min(len(text), start + len(phrase) + errors)
                spans = windows.setdefault(k, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        out = []
        for k, spans in windows.items():
            phrase, label, errors, pattern = self.notices[k]
            numbers = [w for w in phrase.split() if w.isdigit()]
            for lo, hi in spans:
                if hi - lo >= len(phrase) - errors:
                    # One more character on each side shows the word bounds.
                    for m in pattern.finditer(text, lo, min(len(text), hi + 1)):
                        ends = m.end() == len(text) or text[m.end()] == " "
                        if ends and [w for w in m[0].split() if w.isdigit()] == numbers:
                            out.append((m.start(), m.end(), label, sum(m.fuzzy_counts), len(phrase)))
        return sorted(out)

    def find(self, text: str) -> list[tuple[int, int, str, int, int]]:
        """matches() without those that overlap a better one: of more characters, an edit counting EDIT_COST less. Ties
        go to the first start, then to the first label."""
        found = sorted(self.matches(text), key=lambda m: (EDIT_COST * m[3] - m[4], m))
        out: list[tuple[int, int, str, int, int]] = []
        for m in found:
            k = bisect_left(out, m)
            if (k == 0 or out[k - 1][1] <= m[0]) and (k == len(out) or m[1] <= out[k][0]):
                out.insert(k, m)
        return out


def scan(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: word span, label and edits of each fuzzy match; of matches that overlap, the best. score: 1 if a base phrase
    stands there, else the best match's share of characters without an edit, else 0. Null and empty texts have no words,
    no places and empty labels. Very long texts are searched whole. One row comes out for each row in; other columns are
    ignored.
    """
    kind = (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string,"
        " score double, spans array<struct<first_word:long,last_word:long,label:string,edits:int>>"
    )

    def make():  # noqa: ANN202
        fuzzy = Notices(notices)

        def of(batch: pa.RecordBatch) -> dict:
            out: dict[str, list] = {n: [] for n in kind_names}
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                flat = b" ".join(words).decode("utf-8", "replace")
                padded = f" {flat} "
                ats, base = [], set()
                for phrase, label in BASE:
                    at = padded.find(f" {phrase} ")
                    while at >= 0:
                        ats.append(at)
                        base.add(label)
                        at = padded.find(f" {phrase} ", at + 1)
                found = fuzzy.find(flat) if flat else []
                blanks = [k for k, c in enumerate(flat) if c == " "] if ats or found else []
                places = [bisect_left(blanks, at) for at in ats]
                out["n_words"].append(len(words))
                out["n_base"].append(len(places))
                out["first_word"].append(min(places, default=None))
                out["last_word"].append(max(places, default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {x for _, _, x, _, _ in found})))
                out["score"].append(1.0 if places else max((1 - e / n for _, _, _, e, n in found), default=0.0))
                out["spans"].append(
                    [
                        {"first_word": bisect_left(blanks, a), "last_word": bisect_left(blanks, b), "label": x, "edits": e}
                        for a, b, x, e, _ in found
                    ]
                )
            return out | {"doc_id": batch.column("doc_id")}

        return of

    kind_names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), kind, make)
