"""Text units that a word-BPE tokenizer codes independently of each other, and their token ids.

``word_bpe_49k.json`` drops white space and cuts texts into runs of letters, single digits and runs
of other characters before merging. A text's ids are therefore the ids of its units in order, where
units part at white space and at places between two ASCII or Latin characters of different class
(letter, digit, other), or between digits. Places at which the tokenizer's rules could look across
(an apostrophe before a contraction, a special string such as ``<|endoftext|>``, combining or other
non-Latin characters) are never cut. Equal units have equal ids, so each distinct unit is encoded
by the library once and kept in a table that starts anew beyond a fixed number of entries."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from quarry.llm import words as W

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Distinct units kept per Python worker.
KNOWN_UNITS = 2_000_000
#: Text bytes that are coded at a time: enough for most units to be met several times.
BLOCK_BYTES = 1 << 20

_LETTER, _OTHER, _DIGIT, _GLUE = 1, 2, 3, 4


def _classes() -> np.ndarray:
    c = np.full(256, _GLUE, np.uint8)
    b = np.arange(256)
    c[~W.SPACED] = 0
    c[((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))] = _LETTER
    c[(b >= 48) & (b <= 57)] = _DIGIT
    c[(b >= 33) & (b <= 126) & (c == _GLUE)] = _OTHER
    c[[ord(x) for x in "'<|>"]] = _GLUE
    return c


_CLASS = _classes()


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; a path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task uses its own core
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, W.Words, np.ndarray]:
    """(bytes to encode, units with identifiers, whether a unit is one run of letters). A-Z are
    lower-cased, as the tokenizer does, in blocks that hold no special string."""
    raw = buf.tobytes()
    if b"<|" not in raw:
        buf = W.LOWER[buf]
    n = len(buf)
    if not n:
        none = np.zeros(0, np.int64)
        return buf, W.Words(none, none, none.astype(np.uint64), np.zeros(len(offs), np.int64)), none.astype(bool)
    kind = _CLASS[buf]
    lead = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC9))  # U+00C0 to U+027F: letters, but for three
    second = buf[lead + 1]
    lead = lead[~(((buf[lead] == 0xC3) & ((second == 0x97) | (second == 0xB7))) | ((buf[lead] == 0xC4) & (second == 0xB0)))]
    kind[lead] = kind[lead + 1] = _LETTER
    a, b = kind[:-1], kind[1:]
    cut = np.zeros(n + 1, bool)
    cut[1:n] = ((a == 0) != (b == 0)) | ((a != _GLUE) & (b != _GLUE) & (a != 0) & ((a != b) | (a == _DIGIT)))
    cut[0] = cut[n] = True
    cut[offs] = True
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    solid = kind[start] != 0
    start, end = start[solid], end[solid]
    strange = np.concatenate([[0], np.cumsum(kind != _LETTER)])
    plain = strange[end] == strange[start]
    return buf, W.Words(start, end, W.span_ident(buf, start, end), np.searchsorted(start, offs)), plain


def _merged(a: tuple, b: tuple) -> tuple:
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]


class UnitCodes:
    """Token ids of distinct units, encoded by the tokenizers library when first met."""

    def __init__(self, path: str, known_units: int = KNOWN_UNITS):
        self.tokenizer = load_tokenizer(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.limit = known_units
        self._clear()

    def _clear(self):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.tables = [none, none]  # (sorted identifiers, their places): the bulk, and the latest
        self.count, self.used = 0, 0
        self.first, self.many = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.uint32 if self.size > 1 << 16 else np.uint16)

    def _find(self, idents: np.ndarray) -> np.ndarray:
        """Places of known units, -1 for others."""
        out = np.full(len(idents), -1, np.int64)
        for keys, places in self.tables:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, idents), len(keys) - 1)
                hit = keys[i] == idents
                out[hit] = places[i[hit]]
        return out

    def _add(self, idents: np.ndarray, ids: np.ndarray, many: np.ndarray):
        n, k = self.count, len(idents)
        for name, need in (("first", n + k), ("many", n + k), ("ids", self.used + len(ids))):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(max(need - len(have), len(have) // 2), have.dtype)]))
        self.ids[self.used:self.used + len(ids)] = ids
        self.many[n:n + k] = many
        self.first[n:n + k] = self.used + np.cumsum(many) - many
        self.used, self.count = self.used + len(ids), n + k
        bulk, latest = self.tables
        latest = _merged(latest, (idents, np.arange(n, n + k, dtype=np.int32)))
        if len(latest[0]) > 1 << 17:
            bulk, latest = _merged(bulk, latest), (latest[0][:0], latest[1][:0])
        self.tables = [bulk, latest]

    def places(self, buf: np.ndarray, w: W.Words, plain: np.ndarray) -> np.ndarray:
        """For each unit its place in the table (self.first, self.many, self.ids)."""
        distinct, at, back = np.unique(w.ident, return_index=True, return_inverse=True)
        if self.count + len(distinct) > self.limit:
            self._clear()
        got = self._find(distinct)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            first = at[missing]
            text = [buf[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[first].tolist(), w.end[first].tolist())]
            simple = plain[first]
            for one_run in (True, False):
                own = np.flatnonzero(simple == one_run)
                if not len(own):
                    continue
                if one_run:  # one pre-token each: the ends of words part them
                    ids = np.array(self.tokenizer.encode_batch_fast([" ".join([text[i] for i in own])], add_special_tokens=False)[0].ids, np.uint32)
                    many = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                else:
                    each = [e.ids for e in self.tokenizer.encode_batch_fast([text[i] for i in own], add_special_tokens=False)]
                    many = np.array([len(e) for e in each], np.int64)
                    ids = np.array([x for e in each for x in e], np.uint32)
                if len(many) != len(own) or many.sum() != len(ids):
                    raise ValueError("the tokenizer does not code units on their own")
                got[missing[own]] = self.count + np.arange(len(own))
                self._add(distinct[missing[own]], ids, many)
        return got[back]

    def encode(self, buf: np.ndarray, w: W.Words, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents of a block in order, ids per document)."""
        place = self.places(buf, w, plain)
        many = self.many[place].astype(np.int64)
        ids = self.ids[np.repeat(self.first[place], many) + W.ragged(many)]
        total = np.concatenate([[0], np.cumsum(many)])
        return ids, total[w.bound[1:]] - total[w.bound[:-1]]


@lru_cache(maxsize=2)
def unit_codes(path: str) -> UnitCodes:
    return UnitCodes(path)
