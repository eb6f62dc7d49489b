"""Shared by the tests of the llm operators."""

import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LETTERED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

TINY = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor sit amet consectetur " * 60_000  # 2.3 MB, over one block

#: Nulls, empty and odd texts, ties, repeated rows, one very long text.
EDGE = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 4), (None, "no id here at all", "en", "b", 17),
    (4, "one", "en", "b", 3), (5, "One two", None, "b", 7), (6, "One two", "en", "a", 7), (6, "One two", "en", "a", 7),
    (7, "Ünï cödé ß ﬁ İ Σς é é \U0001F600  x y", "fr", "c", 30), (8, LONG, "en", "a", len(LONG)),
    (9, "a" * 5000, "en", "a", 5000), (10, "x y z " * 300, "en", "a", 1800), (11, "\x00\x01\x7f|||", "en", "a", 6),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in rows(df)}


def lower(text):
    return (text or "").translate(LOWER)
