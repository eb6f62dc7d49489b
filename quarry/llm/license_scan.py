"""Licence scan: exact phrases, and a fuzzy search for short notices.

Texts become words (A-Z lower-cased, ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``). The base phrases are
looked up word by word on identifiers. For the fuzzy search a notice that may differ by k edits is cut
into k + 1 pieces: by the pigeonhole principle every match holds one of them unchanged. All pieces are
found exactly in the words joined by single blanks, each hit opens a window around the place the
notice would have, and the regex library matches the notice there with its error bound, which gives
the span and the edits. A match must start and end at word bounds.

Nothing is shuffled; a block of documents at a time is worked on, so a long text costs its own size.

Defined cases: a null or empty text has no words and no labels; rows are independent, so repeated or
null ids stay as they are; extra columns are ignored. Labels are '' where there are none."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.store import bounded_batches

#: Base phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices and their labels: customary wording of public licences (fixed values).
NOTICES = {
    "under the mit license": "mit",
    "released under the mit licence": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2": "apache-2",
    "licensed under the apache license": "apache-2",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution 4 0 international": "cc-by",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
#: One edit is allowed for each so many characters of a notice, MOST_EDITS at most.
CHARS_PER_EDIT, MOST_EDITS = 9, 4


def edits_for(notice: str) -> int:
    return min(MOST_EDITS, len(notice) // CHARS_PER_EDIT)


def pieces(notice: bytes, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece) of edits + 1 pieces of nearly equal length."""
    cut = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:])]


class Scanner:
    def __init__(self, base: dict[str, str], notices: dict[str, str]):
        import regex
        self.base = [(self._idents(p), label) for p, label in base.items()]
        self.fuzzy = []
        for notice, label in notices.items():
            raw, k = notice.encode(), edits_for(notice)
            pattern = regex.compile(rb"(?b)(?<![^ \n])(?:" + regex.escape(raw, special_only=True) + b"){e<=%d}(?![^ \n])" % k)
            self.fuzzy.append((label, raw, k, pieces(raw, k), pattern))

    @staticmethod
    def _idents(phrase: str) -> np.ndarray:
        buf, offs = W.raw(pa.array([phrase]))
        return W.words(W.LOWER[buf], offs, W.LETTERED).ident

    def exact(self, w: W.Words) -> list[tuple[np.ndarray, str]]:
        """First words of all places of each base phrase."""
        at_end = np.repeat(w.bound[1:], np.diff(w.bound))
        out = []
        for ids, label in self.base:
            at = np.flatnonzero(w.ident == ids[0]) if len(ids) else np.zeros(0, np.int64)
            at = at[at + len(ids) <= at_end[at]]
            for j in range(1, len(ids)):
                at = at[w.ident[at + j] == ids[j]]
            out.append((at, label))
        return out

    def near(self, text: bytes):
        """(label, start, end, edits) of fuzzy matches in words joined by blanks, documents by newlines."""
        for label, notice, k, parts, pattern in self.fuzzy:
            places = {}  # where the notice would start: where its unchanged piece is
            for offset, piece in parts:
                at = text.find(piece)
                while at >= 0:
                    places[at - offset] = at
                    at = text.find(piece, at + 1)
            done = 0
            for place in sorted(places):
                seed = places[place]  # the window stays in the seed's document
                lo = max(place - k, done, text.rfind(b"\n", max(place - k, 0), seed) + 1)
                hi = place + len(notice) + 2 * k
                line_end = text.find(b"\n", seed)
                word_end = text.find(b" ", min(hi, line_end))
                hi = line_end if word_end < 0 else min(word_end, line_end)
                if lo >= hi:
                    continue
                m = pattern.search(text, lo, hi)
                if not m:
                    continue
                a, b = m.span()
                a, b = a + (text[a:a + 1] == b" "), b - (text[b - 1:b] == b" ")
                if a < b:
                    done = b
                    yield label, a, b, sum(m.fuzzy_counts)


def joined(buf: np.ndarray, w: W.Words) -> tuple[bytes, np.ndarray]:
    """Words joined by single blanks, each document ended by a newline; the place where each word starts."""
    n = w.end - w.start
    out = np.full(int((n + 1).sum()), 0x20, np.uint8)
    start = np.cumsum(n + 1) - (n + 1)
    out[np.repeat(start, n) + W.ragged(n)] = buf[np.repeat(w.start, n) + W.ragged(n)]
    last = w.bound[1:][np.diff(w.bound) > 0] - 1
    out[start[last] + n[last]] = 0x0A
    return out.tobytes(), start


@lru_cache(maxsize=2)
def _scanner(base: tuple, notices: tuple) -> Scanner:
    return Scanner(dict(base), dict(notices))


_SPAN = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])


def _scan(base: tuple, notices: tuple):
    def run(batches):
        s = _scanner(base, notices)
        for batch in batches:
            for lo, hi, raw, offs in W.blocks(batch.column(1)):
                buf = W.LOWER[raw]
                w = W.words(buf, offs, W.LETTERED)
                rows = hi - lo
                n_base, first, last = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
                labels, more, spans = [set() for _ in range(rows)], [{} for _ in range(rows)], [[] for _ in range(rows)]
                for at, label in s.exact(w):
                    doc = np.searchsorted(w.bound, at, side="right") - 1
                    for d, i in zip(doc.tolist(), (at - w.bound[doc]).tolist()):
                        n_base[d] += 1
                        first[d] = i if first[d] < 0 else min(first[d], i)
                        last[d] = max(last[d], i)
                        labels[d].add(label)
                text, start = joined(buf, w)
                for label, a, b, edits in s.near(text):
                    i, j = (int(np.searchsorted(start, x, side="right")) - 1 for x in (a, b - 1))
                    d = int(np.searchsorted(w.bound, i, side="right")) - 1
                    spans[d].append((label, i - int(w.bound[d]), j - i + 1, edits))
                    share = 1 - edits / max(1, b - a)
                    more[d][label] = max(share, more[d].get(label, 0))
                none = n_base == 0
                score = [1.0 if x else max(m.values(), default=0.0) for x, m in zip(labels, more)]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(lo, rows), "n_words": pa.array(np.diff(w.bound)), "n_base": pa.array(n_base),
                    "first_word": pa.array(first, mask=none), "last_word": pa.array(last, mask=none),
                    "base_labels": pa.array([",".join(sorted(x)) for x in labels]),
                    "labels": pa.array([",".join(sorted(x | set(m))) for x, m in zip(labels, more)]),
                    "score": pa.array(score, pa.float64()),
                    "spans": pa.array([[dict(zip(("label", "first_word", "n_words", "edits"), v)) for v in sorted(x, key=lambda v: (v[1], v[0]))] for x in spans],
                                      pa.list_(_SPAN))})
    return run


def license_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] = BASE,
                    notices: dict[str, str] = NOTICES) -> DataFrame:
    """Per row: the id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a base
    phrase, else the best fuzzy match's share of unchanged characters) and spans (of fuzzy matches)."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = (f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
             "score double, spans array<struct<label:string,first_word:long,n_words:long,edits:int>>")
    return (docs.select(F.col(id_col), F.col(text_col))
            .mapInArrow(_scan(tuple(base.items()), tuple(notices.items())), shape).withColumnRenamed("id", id_col))
