import hashlib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import rows

from quarry.llm import sentence_pieces as S
from quarry.llm import units as U
from quarry.llm import words as W

sentencepiece = pytest.importorskip("sentencepiece")
PATH = U.tokenizer_path(S.DEFAULT_MODEL)

PARTS = ["▁", " ", "  ", "\n", "\t", "\r", "a", "the", "The", "é", "é", "ß", "ﬁ", "①", "ＡＢＣ", "１２", "が", "が", "漢字", "😀", "👩‍👩‍👧", "9", "42",
         ".", "!!", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "\x7f", " ", "​", "﻿", "�", "½", "²", "Ω", "İ", "don't", "-", "_"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def want_rows(docs):
    sp, out = library(), []
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in docs:
        ids = sp.encode(r.text or "", add_eos=True)
        out.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))))
    return sorted(out, key=str)


def test_digests_equal_the_library(tiny, edge, empty):
    for df in (tiny, edge):
        got = S.piece_digests(df).collect()
        assert sorted((tuple(r)[:4] for r in got), key=str) == want_rows(df.collect())
        assert all(r["n_bytes"] == r["n_covered"] for r in got)
    assert S.piece_digests(empty).count() == 0


def test_odd_texts_and_a_table_that_starts_anew():
    rng = random.Random(11)
    sp, codes = library(), S.PieceCodes(PATH, known_units=300)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(0, 14))) for _ in range(4000)]
    for i in range(0, len(texts), 250):
        part = texts[i:i + 250]
        buf, offs = W.raw(pa.array(part))
        ids, n, start, end = codes.spans(buf, offs)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == sp.encode(part)
        for t, a, b in zip(part, np.split(start, np.cumsum(n)[:-1]), np.split(end, np.cumsum(n)[:-1])):
            raw = t.encode()
            assert b"".join(raw[x:y] for x, y in zip(a.tolist(), b.tolist())) == raw  # spans tile the text


def test_spans_show_each_piece(spark):
    docs = spark.createDataFrame([(1, "Hello  wörld 漢\n▁x"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(S.encoded(docs))}
    sp, raw = library(), "Hello  wörld 漢\n▁x".encode()
    for i, a, b in zip(got[1]["ids"], got[1]["starts"], got[1]["ends"]):
        piece = sp.id_to_piece(i)
        if not sp.is_byte(i) and i != sp.eos_id():
            assert raw[a:b].decode().replace(" ", "▁") == (piece[1:] if a == 0 else piece)
    assert got[1]["decoded"] == "Hello  wörld 漢\n x" and got[2] == {"doc_id": 2, "ids": [2], "starts": [0], "ends": [0], "decoded": ""}


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
def test_compiled_maps_normalise_as_the_library(rule):
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    made = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto.ParseFromString(made.serialized_model_proto())
    spec = proto.normalizer_spec
    mine = S.Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.escape_whitespaces, spec.remove_extra_whitespaces, False)
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randrange(0, 12)))
        out, source = mine.one(text.encode())
        assert out.decode() == made.normalize(text)
        assert len(source) == len(out) + 1 and sorted(source) == source
        plain, offsets = made.normalize(text, with_offsets=True)  # offsets of characters
        at, chars = ([0, *itertools.accumulate(len(c.encode()) for c in t)] for t in (plain, text))
        assert not plain or [source[i] for i in at] == [chars[i] for i in offsets]


def test_malformed_bytes_are_lost_characters():
    mine = S.Normalizer(b"", True, True, False, False)
    raw = b"a\xff\xe2\x96b\xc0\x80 \xed\xa0\x80"
    buf, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    out, noffs, source = mine.block(buf, offs)
    assert out.tobytes().decode() == "▁a���b��▁���" and len(source) == len(out) + 1
    sp = library()
    assert [int(i) for i in S.PieceCodes(PATH).spans(buf, offs)[0]] == sp.encode(raw)


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([("k", "a b", 1), (None, "", 2)], "id string, text string, ids int")
    assert {r["id"]: r["n_tokens"] for r in S.piece_digests(docs, id_col="id").collect()} == {"k": 3, None: 1}


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.byte_fallback = False
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        S.PieceCodes(str(tmp_path / "m.model"))
