"""Periodic runs of words by recursive frequency splitting.

A run of period q that counts is at least LEAST words and ROUNDS * q words long, so each of its words occurs
ROUNDS times in it at least. A word that occurs less often within its segment (at first the document) is
in no such run and splits the segment there; the pieces are judged again by their own counts, until none
changes. Pieces shorter than LEAST go. What survives is lag-scanned: the segment is compared with itself q words
later, and every maximal stretch of agreement that is long enough is a run, unless a run of a smaller
period that divides q covers it (then q is not the stretch's smallest period).

The lags worth a scan are told by repeated grams: with grams of g >= q words inside a run of smallest period
q, the next place of a gram is exactly q words on, for long enough to be told from chance. Grams double
from one word on, and each length g proposes the lags above g / 2 up to g. So a segment of n words costs n log n for
each doubling and n for each lag that a run may have, and no lag is left out.

All blocks of documents are worked on in tasks, without a shuffle; words are 64-bit identifiers (words.py).

Defined cases: a null or empty text has no words and no run, and collapses to the empty string; rows that
repeat a doc_id are judged each by its own text; a null doc_id stays; ties for the longest run go to
the smallest start, then the smallest period; extra columns are ignored."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.store import bounded_batches

#: Least number of words of a run, and of its periods.
LEAST, ROUNDS = 6, 4
#: Words of a document that are joined at a time.
CHUNK = 1 << 15

_U = np.uint64
_NONE = np.zeros(0, np.int64)


def _segments(at: np.ndarray, group: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lasts (indexes into ``at``) of the stretches of consecutive places of one group that have
    ``least`` places or more."""
    if not len(at):
        return _NONE, _NONE
    edge = np.flatnonzero((at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])) + 1
    first, past = np.append(0, edge), np.append(edge, len(at))
    ok = past - first >= least
    return first[ok], past[ok]


def surviving(ident: np.ndarray, bound: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the segments in which every word occurs ``rounds`` times at least."""
    starts, ends = [], []
    at = np.arange(len(ident))
    group = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    first, past = _segments(at, group, least)
    while len(first):
        size = past - first
        at = np.repeat(at[first], size) + W.ragged(size)
        group = np.repeat(np.arange(len(first)), size)
        key = W.mix(ident[at] + group.astype(_U) * _U(W._BASE))
        _, back, many = np.unique(key, return_inverse=True, return_counts=True)
        stays = many[back] >= rounds
        settled = np.ones(len(first), bool)
        settled[group[~stays]] = False
        head = at[np.cumsum(size) - size]
        starts.append(head[settled])
        ends.append((head + size)[settled])
        open_ = stays & ~settled[group]
        at, group = at[open_], group[open_]
        first, past = _segments(at, group, least)
    if not starts:
        return _NONE, _NONE
    start, end = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(start)
    return start[order], end[order]


def _lags(ident: np.ndarray, start: np.ndarray, end: np.ndarray, least: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, lag) pairs at which a run can lie, by segment and then lag."""
    seg, lag = [], []
    size = end - start
    group = np.repeat(np.arange(len(start)), size)
    at = np.repeat(start, size) + W.ragged(size)  # place of each gram's first word
    past = end[group]
    gram, g = ident[at], 1
    while len(at):
        order = np.lexsort((at, gram, group))
        near = np.flatnonzero((gram[order[1:]] == gram[order[:-1]]) & (group[order[1:]] == group[order[:-1]]))
        step = np.zeros(len(at), np.int64)
        step[order[near]] = at[order[near + 1]] - at[order[near]]
        step[(step <= g // 2) | (step > g)] = 0
        edge = np.flatnonzero((step[1:] != step[:-1]) | (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])) + 1
        first, after = np.append(0, edge), np.append(edge, len(at))
        q = step[first]
        ok = (q > 0) & (after - first >= np.maximum(least, rounds * q) - q - g + 1)
        seg.append(group[first[ok]])
        lag.append(q[ok])
        # grams of twice the length, where a longer lag still fits
        follows = np.zeros(len(at), bool)
        if len(at) > g:
            follows[:-g] = (at[g:] == at[:-g] + g) & (group[g:] == group[:-g])
        keep = np.flatnonzero(follows & (at + 2 * g <= past) & (size[group] >= rounds * (g + 1)))
        gram = W.mix(gram[keep] * _U(W._BASE) + gram[np.minimum(keep + g, len(gram) - 1)])
        at, group, past, g = at[keep], group[keep], past[keep], 2 * g
    seg, lag = np.concatenate(seg) if seg else _NONE, np.concatenate(lag) if lag else _NONE
    pair = np.unique(np.stack([seg, lag], axis=1), axis=0)
    return pair[:, 0], pair[:, 1]


def runs(ident: np.ndarray, bound: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a block of documents, by start and then period. ``bound[d]`` is the
    first word of document d."""
    start, end = surviving(ident, bound, least, rounds)
    found = []
    here, seg_before = [], -1
    for s, q in zip(*(x.tolist() for x in _lags(ident, start, end, least, rounds))):
        if s != seg_before:
            here, seg_before = [], s
        x = ident[start[s]:end[s]]
        same = np.zeros(len(x) - q + 2, np.int8)
        same[1:-1] = x[q:] == x[:-q]
        turn = np.flatnonzero(np.diff(same))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            size = b - a + q
            if size >= max(least, rounds * q) and not any(q % p == 0 and c <= a and a + size <= d for c, d, p in here):
                here.append((a, a + size, q))
                found.append((int(start[s]) + a, size, q))
    if not found:
        return _NONE, _NONE, _NONE
    out = np.array(sorted(found), np.int64)
    order = np.lexsort((out[:, 2], out[:, 0]))
    return tuple(out[order].T)


def _collapsed(raw: bytes, start: np.ndarray, end: np.ndarray, dropped: np.ndarray):
    """Pieces of the kept words joined by one space."""
    sep = b""
    for lo in range(0, len(start), CHUNK):
        hi = min(lo + CHUNK, len(start))
        if dropped[lo:hi].any():
            some = np.flatnonzero(~dropped[lo:hi]) + lo
            words = [raw[a:b] for a, b in zip(start[some].tolist(), end[some].tolist())]
        else:
            words = raw[start[lo]:end[hi - 1]].split()
        if words:
            yield sep + b" ".join(words)
            sep = b" "


def _found(least: int, rounds: int, with_runs: bool):
    def run(batches):
        for batch in batches:
            for lo, hi, buf, offs in W.blocks(batch.column(1)):
                w = W.words(buf, offs, W.SPACED)
                start, length, period = runs(w.ident, w.bound, least, rounds)
                cover = np.zeros(len(w.ident) + 1, np.int32)
                np.add.at(cover, start + period, 1)
                np.add.at(cover, start + length, -1)
                dropped = np.cumsum(cover[:-1]) > 0
                cut = np.searchsorted(start, w.bound)
                raw = buf.tobytes()
                texts, digests, rows = [], [], []
                for d in range(hi - lo):
                    a, b = w.bound[d], w.bound[d + 1]
                    own = slice(cut[d], cut[d + 1])
                    rows.append(list(zip((start[own] - a).tolist(), length[own].tolist(), period[own].tolist())))
                    pieces = _collapsed(raw, w.start[a:b], w.end[a:b], dropped[a:b])
                    if with_runs:
                        texts.append(b"".join(pieces))
                    else:
                        h = hashlib.sha256()
                        for p in pieces:
                            h.update(p)
                        digests.append(h.hexdigest())
                ids = batch.column(0).slice(lo, hi - lo)
                if with_runs:
                    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                    yield pa.RecordBatch.from_pydict({
                        "id": ids, "n_words": pa.array(np.diff(w.bound)),
                        "runs": pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in rows], shape),
                        "collapsed": pa.array(texts, pa.binary()).cast(pa.string())})
                    continue
                best = [max(x, key=lambda r: (r[1], -r[0], -r[2])) if x else (None, None, None) for x in rows]
                yield pa.RecordBatch.from_pydict({
                    "id": ids, "n_runs": pa.array([len(x) for x in rows], pa.int64()),
                    **{c: pa.array([x[i] for x in best], pa.int64()) for i, c in enumerate(("start", "length", "period"))},
                    "exponent_milli": pa.array([x[0] is not None and 1000 * x[1] // x[2] or None for x in best], pa.int64()),
                    "runs_sha256": pa.array([hashlib.sha256("".join("%d,%d,%d\n" % r for r in x).encode()).hexdigest() for x in rows]),
                    "collapsed_sha256": pa.array(digests)})
    return run


def _apply(docs: DataFrame, id_col: str, text_col: str, fn, rest: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(fn, f"id {kind}, {rest}").withColumnRenamed("id", id_col)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """Per row: the id, n_words, runs (start, length, period by start and period) and the text without the repetitions:
    of each run only the first period stays."""
    return _apply(docs, id_col, text_col, _found(least, rounds, True),
                  "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """Per row: the id, n_runs, the longest run (start, length, period, exponent_milli; nulls without one), and the
    sha256 of all runs and of the collapsed text."""
    return _apply(docs, id_col, text_col, _found(least, rounds, False),
                  "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def looped_words(words: list, doc_id: int | None) -> list:
    """The words of a document with a loop planted by its id: in one of ten documents, told by the crc32 of the
    decimal id, the words from some place on repeat the first few from there. Without an id, nothing is planted."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a:a + p]
    return words[:a] + (loop * (-(-(n - a) // p)))[:n - a]


def _looped(batches):
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for lo, hi, buf, offs in W.blocks(batch.column(1)):
            raw = buf.tobytes()
            texts = []
            for d, doc_id in enumerate(ids[lo:hi]):
                text = raw[offs[d]:offs[d + 1]]
                planted = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0
                texts.append(b" ".join(looped_words(text.split(), doc_id)) if planted else text)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "text"])


def with_loops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with the loops of ``looped_words`` in the texts of one document in ten."""
    return _apply(docs, id_col, text_col, _looped, "text string")
