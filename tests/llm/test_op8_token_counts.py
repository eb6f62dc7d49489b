import random

import numpy as np
import pyarrow as pa
from llm.helpers import EDGE, TINY  # noqa: F401

from quarry.llm import units as U
from quarry.llm import words as W
from quarry.llm.token_counts import token_counts, whole_tokens

PATH = U.tokenizer_path(U.DEFAULT_TOKENIZER)


def library(texts):
    return [len(e.ids) for e in U.load_tokenizer(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(df):
    docs = df.collect()
    texts = [r.text for r in docs]
    want = sorted(((r.doc_id, len((r.text or "").encode()), n, n > 2048) for r, n in zip(docs, library(texts))), key=str)
    assert sorted((tuple(r) for r in token_counts(df).collect()), key=str) == want


def test_counts_equal_the_library(tiny, edge, empty):
    check(tiny)
    check(edge)
    assert token_counts(empty).count() == 0


def test_more_units_than_the_first_tables_hold(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefghiklmnoprstuwz", k=9)) for _ in range(30_000)) for _ in range(4)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1))


def test_units_on_odd_texts():
    rng = random.Random(3)
    parts = ["'", "'s", "'re", "'LL", "s", "t", "A", "b", "É", "é", "ß", "İ", "Σ", "σς", "́", "̸", "=", "<", "|", ">", "<|", "|>",
             "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "</w>", ".", "!!", "9", "42", "½", "²", "٣", " ", "\n", " ", " ", "\u0085",
             "\x1c", "\x00", "\x7f", "Ǆ", "Ⱥ", "×", "÷", "ª", "漢", "😀", "the", "THING", "don't", "�", "ﬁ", "가", "-", "_"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(6000)]
    codes = U.UnitCodes(PATH, known_units=500)  # the table starts anew many times
    t = U.load_tokenizer(PATH)
    for i in range(0, len(texts), 300):
        part = texts[i:i + 300]
        buf, offs = W.raw(pa.array(part))
        ids, n = codes.encode(*U.units(buf, offs))
        want = [e.ids for e in t.encode_batch(part, add_special_tokens=False)]
        cut = np.cumsum(n)[:-1]
        assert [x.tolist() for x in np.split(ids, cut)] == want


def test_whole_tokens_are_most_of_the_vocabulary():
    assert 20_000 < len(whole_tokens(PATH)) <= 49_408
