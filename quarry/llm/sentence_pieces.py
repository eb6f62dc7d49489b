"""SentencePiece encoding and decoding that keeps offsets.

Texts are normalised here, by longest prefixes through the model's compiled character map, and every normalised byte
records the source byte it comes from. The normalised text is cut where no piece of the vocabulary can reach across;
each distinct unit between two cuts is merged once by the library (a model of the same pieces whose own normaliser is
off), and a piece's length in bytes follows from its id. So each piece lies on a span of normalised bytes, which the
alignment projects to a span of the original bytes.

Where nothing reaches across: a run of white space symbols may only open pieces (checked on the vocabulary), so a unit
starts at each; two ASCII characters that stand side by side in no piece part units too. Merging joins neighbours
into a piece of the vocabulary, so it never crosses such a place, and units are coded on their own.

The map is a double array of 32-bit cells (a byte's label, an offset to its children, a flag for an end) and a
block of NUL-ended replacements. Without a map, texts are normalised by numpy a block at a time.

A piece's span starts at the source of its first byte and ends at the source of the byte after its last. The dummy space in
front has no source, and a replaced sequence belongs to the piece that holds its last byte. Spans of a document do
not overlap, and together they cover the text, except white space that the model removes.

Defined cases: a null or empty text has no pieces but the end id; malformed bytes become U+FFFD, as in the library;
rows are independent, so repeated and null ids stay as they are; extra columns are ignored. Models other than BPE with
byte fallback, or with user-defined pieces, are refused."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import units as U
from quarry.llm import words as W
from quarry.llm.store import bounded_batches

DEFAULT_MODEL = "piece_bpe_32k.model"
#: Distinct units kept per Python worker.
KNOWN_UNITS = 1_000_000
#: Text bytes that are coded at a time.
BLOCK_BYTES = 1 << 20

SPACE = "▁".encode()
_LOST = "�".encode()
_BPE, _USER = 2, 4


class Normalizer:
    """The model's normalisation with the source of every byte."""

    def __init__(self, charsmap: bytes, dummy: bool, escape: bool, trim: bool, suffix: bool):
        self.dummy, self.trim, self.suffix = dummy, trim, suffix
        self.space = SPACE if escape else b" "
        self.cells, self.strings = None, b""
        if charsmap:
            size = int.from_bytes(charsmap[:4], "little")
            self.cells = np.frombuffer(charsmap[4:4 + size], "<u4").tolist()
            self.strings = charsmap[4 + size:]

    def _mapped(self, raw: bytes, i: int) -> tuple[int, bytes] | None:
        """The longest key of the map at byte i: (its length, what replaces it)."""
        if self.cells is None:
            return None
        cell, best = self.cells[0], None
        node = (cell >> 10) << ((cell & 0x200) >> 6)
        for j in range(i, len(raw)):
            node ^= raw[j]
            if node >= len(self.cells):
                break
            cell = self.cells[node]
            if cell & 0x800000FF != raw[j]:
                break
            node ^= (cell >> 10) << ((cell & 0x200) >> 6)
            if cell >> 8 & 1:
                best = j + 1 - i, self.cells[node] & 0x7FFFFFFF
        if best is None:
            return None
        return best[0], self.strings[best[1]:self.strings.index(b"\0", best[1])]

    @staticmethod
    def _character(raw: bytes, i: int) -> tuple[int, bytes]:
        """The code point at byte i; a malformed byte is lost."""
        lead = raw[i]
        size = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
        part = raw[i:i + size]
        try:
            part.decode()
        except UnicodeDecodeError:
            size = 0
        return (size, part) if size else (1, _LOST)

    def one(self, raw: bytes) -> tuple[bytes, list[int]]:
        """(normalised bytes, source of each and the end) of one text, character by character."""
        out, source = bytearray(), []
        i, n = 0, len(raw)

        def add(part: bytes, own: bool):
            for j, b in enumerate(part):
                if b == 0x20:
                    out.extend(self.space)
                    source.extend([i] * len(self.space))
                else:
                    out.append(b)
                    source.append(i + j if own else i)

        step = lambda: self._mapped(raw, i) or self._character(raw, i)
        if self.trim:
            while i < n and step()[1] == b" ":
                i += step()[0]
        if i == n:
            return b"", [n]
        if self.dummy and not self.suffix:
            add(b" ", False)
        after_space = self.trim
        while i < n:
            size, part = step()
            own = part == raw[i:i + size]
            if after_space:
                part = part.lstrip(b" ")
            if part:
                add(part, own)
                after_space = self.trim and part.endswith(b" ")
            i += size
        if self.trim:
            while out.endswith(self.space):
                i = source[len(out) - len(self.space)]
                del out[-len(self.space):], source[-len(self.space):]
        if self.dummy and self.suffix:
            add(b" ", False)
        return bytes(out), [*source, i]

    def block(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes, offsets, sources) of a block of texts. ``sources`` has, per document, an entry for each
        byte and one for the end, counted from the document's first byte."""
        plain = self.cells is None and not self.trim and not self.suffix
        if plain:
            try:
                buf.tobytes().decode()
            except UnicodeDecodeError:
                plain = False
            else:  # texts may part a character only if they are malformed themselves
                inner = offs[(offs > 0) & (offs < len(buf))]
                plain = not ((buf[inner] & 0xC0) == 0x80).any()
        if not plain:
            raw = buf.tobytes()
            done = [self.one(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            return (np.frombuffer(b"".join(t for t, _ in done), np.uint8), np.cumsum([0] + [len(t) for t, _ in done]),
                    np.array([x for _, s in done for x in s], np.int64))
        size = np.diff(offs)
        some = size > 0
        front = offs[:-1][some] if self.dummy else offs[:0]
        text, place = np.insert(buf, front, 0x20), np.insert(np.arange(len(buf)), front, front)
        lead = np.concatenate([[0], np.cumsum(some)]) if self.dummy else np.zeros(len(offs), np.int64)
        width = np.where(text == 0x20, len(self.space), 1)
        total = np.concatenate([[0], np.cumsum(width)])
        at = np.repeat(np.arange(len(text)), width)
        out = text[at]
        gap = np.flatnonzero(text == 0x20)
        for j, b in enumerate(self.space):
            out[total[gap] + j] = b
        noffs = total[offs + lead]
        doc = np.repeat(np.arange(len(size)), np.diff(noffs))
        sources = np.empty(len(out) + len(size), np.int64)
        sources[np.arange(len(out)) + doc] = place[at] - offs[doc]
        sources[noffs[1:] + np.arange(len(size))] = size
        return out, noffs, sources


class PieceCodes(U.UnitCodes):
    """Piece ids of distinct units, merged by the library when first met."""

    def __init__(self, path: str, known_units: int = KNOWN_UNITS):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != _BPE or not proto.trainer_spec.byte_fallback or any(p.type == _USER for p in proto.pieces):
            raise ValueError("only BPE models with byte fallback and without user-defined pieces are coded by units")
        self.library = SentencePieceProcessor(model_proto=proto.SerializeToString())
        spec = proto.normalizer_spec
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.escape_whitespaces,
                                     spec.remove_extra_whitespaces, proto.trainer_spec.treat_whitespace_as_suffix)
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.escape_whitespaces = spec.remove_extra_whitespaces = False
        self.merger = SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.end = self.library.eos_id()
        if self.end < 0:
            raise ValueError("the model has no end id")
        self.size, self.limit = len(proto.pieces), known_units
        #: Normalised bytes of each id: a byte piece stands for one.
        self.width = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int64)
        texts = [p.piece for p in proto.pieces if p.type == 1]
        self.opens = not any("▁" in t.lstrip("▁") for t in texts)
        self.beside = np.zeros((256, 256), bool)
        self.beside[:, 128:] = self.beside[128:, :] = True
        for t in texts:
            b = np.frombuffer(t.encode(), np.uint8)
            self.beside[b[:-1], b[1:]] = True
        digits = [str(i).encode() for i in range(self.size)]
        self.digits = np.array([[*d.ljust(len(digits[-1]) + 1, b"\0")] for d in digits], np.uint8)
        self.digit_count = np.array([len(d) for d in digits], np.int64)
        self._clear()

    def units(self, buf: np.ndarray, offs: np.ndarray) -> W.Words:
        """Units of a block of normalised texts."""
        n = len(buf)
        if not n:
            none = np.zeros(0, np.int64)
            return W.Words(none, none, none.astype(np.uint64), np.zeros(len(offs), np.int64))
        cut = np.zeros(n + 1, bool)
        cut[1:n] = ~self.beside[buf[:-1], buf[1:]]
        if self.opens and n >= 3:
            gap = np.zeros(n + 3, bool)
            gap[3:n + 1] = (buf[:-2] == SPACE[0]) & (buf[1:-1] == SPACE[1]) & (buf[2:] == SPACE[2])
            cut[:n] |= gap[3:] & ~gap[:n]
        cut[0] = cut[n] = True
        cut[offs] = True
        edge = np.flatnonzero(cut)
        start, end = edge[:-1], edge[1:]
        return W.Words(start, end, W.span_ident(buf, start, end), np.searchsorted(start, offs))

    def places(self, buf: np.ndarray, w: W.Words) -> np.ndarray:
        """For each unit its place in the table (self.first, self.many, self.ids)."""
        distinct, at, back = np.unique(w.ident, return_index=True, return_inverse=True)
        if self.count + len(distinct) > self.limit:
            self._clear()
        got = self._find(distinct)
        missing = np.flatnonzero(got < 0)
        if len(missing):
            raw, first = buf.tobytes(), at[missing]
            texts = [raw[a:b].decode() for a, b in zip(w.start[first].tolist(), w.end[first].tolist())]
            each = self.merger.encode(texts, num_threads=1)
            many = np.array([len(e) for e in each], np.int64)
            ids = np.array([x for e in each for x in e], np.uint32)
            total = np.concatenate([[0], np.cumsum(self.width[ids])])
            if (np.diff(total[np.concatenate([[0], np.cumsum(many)])]) != (w.end - w.start)[first]).any():
                raise ValueError("the pieces of a unit do not make up its text")
            got[missing] = self.count + np.arange(len(missing))
            self._add(distinct[missing], ids, many)
        return got[back]

    def spans(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
        """(ids, ids per document, span starts, span ends) of a block of texts; spans count from the text's first byte."""
        text, noffs, sources = self.normalizer.block(buf, offs)
        w = self.units(text, noffs)
        place = self.places(text, w)
        many = self.many[place].astype(np.int64)
        ids = self.ids[np.repeat(self.first[place], many) + W.ragged(many)]
        total = np.concatenate([[0], np.cumsum(many)])
        n = total[w.bound[1:]] - total[w.bound[:-1]]
        last = np.cumsum(self.width[ids])
        doc = np.repeat(np.arange(len(n)), n)
        return ids, n, sources[last - self.width[ids] + doc], sources[last + doc]


@lru_cache(maxsize=2)
def piece_codes(path: str) -> PieceCodes:
    return PieceCodes(path)


def _with_end(codes: PieceCodes, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.insert(ids.astype(np.int64), np.cumsum(n), codes.end)


def _encoded(path: str):
    def run(batches):
        codes = piece_codes(path)
        for batch in batches:
            for lo, hi, buf, offs in W.blocks(batch.column(1), BLOCK_BYTES):
                ids, n, start, end = codes.spans(buf, offs)
                stop = np.cumsum(n)
                size = np.diff(offs)
                cut = pa.array(np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in
                         (_with_end(codes, ids, n), np.insert(start, stop, size), np.insert(end, stop, size))]
                texts = [codes.library.decode(x) for x in lists[0].to_pylist()]
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(lo, hi - lo), "ids": lists[0], "starts": lists[1],
                                                  "ends": lists[2], "decoded": pa.array(texts, pa.string())})
    return run


def _digests(path: str):
    def run(batches):
        codes = piece_codes(path)
        for batch in batches:
            for lo, hi, buf, offs in W.blocks(batch.column(1), BLOCK_BYTES):
                ids, n, start, end = codes.spans(buf, offs)
                covered = np.concatenate([[0], np.cumsum(end - start)])
                last = np.cumsum(n)
                covered = covered[last] - covered[last - n]
                ids, n = _with_end(codes, ids, n), n + 1
                # decimal ids, a space after each
                width = codes.digit_count[ids] + 1
                text = codes.digits[ids]
                text[np.arange(len(ids)), width - 1] = 0x20
                text = text[text != 0].tobytes()
                edge = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(n)])].tolist()
                listed, cut = ids.tolist(), np.concatenate([[0], np.cumsum(n)]).tolist()
                sha, decoded = [], []
                for d in range(hi - lo):
                    sha.append(hashlib.sha256(text[edge[d]:edge[d + 1] - 1]).hexdigest())
                    back = codes.library.decode(listed[cut[d]:cut[d + 1]])
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(lo, hi - lo), "n_tokens": pa.array(n.astype(np.int64)), "ids_sha256": pa.array(sha),
                    "decoded_sha256": pa.array(decoded), "n_bytes": pa.array(np.diff(offs)), "n_covered": pa.array(covered)})
    return run


def _apply(docs: DataFrame, id_col: str, text_col: str, fn, rest: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(fn, f"id {kind}, {rest}").withColumnRenamed("id", id_col)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """Per row: the id, ids (the end id last), the original byte span of each id (starts, ends; the end id's is empty) and
    what the library decodes from the ids."""
    return _apply(docs, id_col, text_col, _encoded(U.tokenizer_path(model)),
                  "ids array<int>, starts array<int>, ends array<int>, decoded string")


def piece_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """Per row: the id, n_tokens (with the end id), sha256 of the decimal ids and of the decoded text, n_bytes, and
    n_covered, the original bytes under the pieces' spans."""
    return _apply(docs, id_col, text_col, _digests(U.tokenizer_path(model)),
                  "n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, n_covered long")
