"""Benchmark decontamination by suffix arrays over the training texts.

Training texts stay where the scan puts them: each block of documents is a shard with a sorted
suffix array over its word identifiers, compared to the depth of a window. Every test suffix is
binary-searched in every shard, which yields all verbatim matches with their places; matches on
one diagonal (same item, same shift) join into the longest verbatim match. Only training suffixes
whose leading words open some test window enter the array, as no search can end at the others.

The benchmark is read through the driver in blocks of a bounded number of bytes (``block_bytes``); each
block is broadcast on its own and scanned by its own pass over the rows, in the same stage. A block is
bounded, their number is not: the broadcasts stay side by side, so the benchmark as a whole has to fit in
the driver and, next to a task's rows, in an executor's workers. No shuffle is needed.

Defined cases: a null or empty text has no words, hits nothing and is hit by nothing; an item of
fewer words than the window is one window by itself; a null item_id counts as the empty string;
rows that repeat a doc_id are judged each by its own text; extra columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import words as W
from quarry.llm.store import bounded_batches

#: Consecutive words of an item that make a leak.
WINDOW = 10
#: Benchmark bytes that are broadcast at a time.
BLOCK_BYTES = 16 << 20

MATCHES = T.ArrayType(T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("doc_start", T.IntegerType()),
    T.StructField("item_start", T.IntegerType()), T.StructField("n_words", T.IntegerType())]))
_MATCH = pa.struct([("item_id", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()),
                    ("n_words", pa.int32())])


class Suffixes:
    """The test suffixes of one benchmark block: ``depth`` leading words of each, 0 beyond its length."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        col = pa.array(texts, pa.string())
        buf, offs = W.raw(col)
        w = W.words(W.LOWER[buf], offs, W.LETTERED)
        n = np.diff(w.bound)
        self.ids = np.array(ids, dtype=object)
        size = np.minimum(n, window)
        many = np.where(n > 0, n - size + 1, 0)
        self.item = np.repeat(np.arange(len(n)), many)
        self.at = W.ragged(many)
        self.size = size[self.item]
        self.depth = int(self.size.max()) if len(self.size) else 0
        first = w.bound[:-1][self.item] + self.at
        step = np.arange(self.depth)
        live = step < self.size[:, None]
        self.key = np.where(live, w.ident[np.minimum(first[:, None] + step, max(len(w.ident) - 1, 0))], 0) \
            if self.depth else np.zeros((0, 0), np.uint64)
        self.lead = int(min(3, self.size.min())) if self.depth else 0
        if self.lead:
            h = self.key[:, 0].copy()
            for j in range(1, self.lead):
                h = W.mix(h * np.uint64(W._BASE) + self.key[:, j])
            self.leads = np.unique(h)
            self.sieve = np.zeros(1 << 20, bool)
            self.sieve[self.leads >> np.uint64(44)] = True


def _bounds(sorted_key: np.ndarray, q: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last suffix that opens with each test suffix: binary searches side by side."""
    out = []
    step = np.arange(q.depth)
    live = step < q.size[:, None]
    for upper in (False, True):
        lo, hi = np.zeros(len(q.key), np.int64), np.full(len(q.key), len(sorted_key), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            got = sorted_key[np.minimum(mid, len(sorted_key) - 1)]
            differs = (got != q.key) & live
            at = differs.argmax(axis=1)
            row = np.arange(len(at))
            equal = ~differs[row, at]
            less = got[row, at] < q.key[row, at]
            right = (less & ~equal) | (equal & upper)
            open_ = lo < hi
            lo = np.where(open_ & right, mid + 1, lo)
            hi = np.where(open_ & ~right, mid, hi)
        out.append(lo)
    return out[0], out[1]


def _shard(w: W.Words, q: Suffixes) -> tuple[np.ndarray, ...]:
    """Longest matches in one shard: (document, item, start in the document, start in the item, words)."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not q.lead:
        return none
    at, lead = W.grams(w, q.lead)
    seen = q.sieve[lead >> np.uint64(44)]
    at, lead = at[seen], lead[seen]
    if len(at):
        near = np.minimum(np.searchsorted(q.leads, lead), len(q.leads) - 1)
        at = at[q.leads[near] == lead]
    if not len(at):
        return none
    doc_of = np.searchsorted(w.bound, at, side="right") - 1
    last = w.bound[doc_of + 1]
    place = at[:, None] + np.arange(q.depth)
    key = np.where(place < last[:, None], w.ident[np.minimum(place, len(w.ident) - 1)], 0)
    order = np.lexsort(key.T[::-1])
    lo, hi = _bounds(key[order], q)
    many = hi - lo
    probe = np.repeat(np.arange(len(many)), many)
    if not len(probe):
        return none
    pos = at[order[np.repeat(lo, many) + W.ragged(many)]]
    doc = np.searchsorted(w.bound, pos, side="right") - 1
    item, shift = q.item[probe], pos - q.at[probe]
    by = np.lexsort((pos, shift, item))
    item, shift, pos, doc, probe = item[by], shift[by], pos[by], doc[by], probe[by]
    new = np.ones(len(pos), bool)
    new[1:] = (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(pos)) - 1
    n = pos[end] + q.size[probe[end]] - pos[first]
    back = np.argsort(doc[first], kind="stable")
    first, n = first[back], n[back]
    return doc[first], item[first], pos[first] - w.bound[doc[first]], q.at[probe[first]], n


def _scan(test, carried: list[str], later: bool, last: bool, with_text: bool):
    """mapInArrow body of one pass. ``later``: matches of earlier passes come in with the rows."""
    def run(batches):
        q = test.value
        for batch in batches:
            for lo, hi, buf, offs in W.blocks(batch.column("text")):
                w = W.words(W.LOWER[buf], offs, W.LETTERED)
                doc, item, start, item_start, n = _shard(w, q)
                cut = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                new = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(list(q.ids[item]), pa.string())] + [pa.array(x.astype(np.int32)) for x in (start, item_start, n)],
                    fields=list(_MATCH)))
                part = batch.slice(lo, hi - lo)
                if later:
                    new = pa.array([a + b for a, b in zip(part.column("matches").to_pylist(), new.to_pylist())],
                                   pa.list_(_MATCH))
                out = {c: part.column(c) for c in carried}
                if with_text or not last:
                    out["text"] = part.column("text")
                if last:
                    out |= _judge(w, new)
                yield pa.RecordBatch.from_pydict({**out, "matches": new})
    return run


def _judge(w: W.Words, matches: pa.ListArray) -> dict[str, pa.Array]:
    rows, cut = len(matches), np.asarray(matches.offsets)
    n_words = np.diff(w.bound)
    flat = matches.values
    start, size = np.asarray(flat.field(1)).astype(np.int64), np.asarray(flat.field(3)).astype(np.int64)
    first = w.bound[np.repeat(np.arange(rows), np.diff(cut))] + start
    cover = np.zeros(len(w.ident) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + size, -1)
    hit = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    longest = np.zeros(rows, np.int64)
    np.maximum.at(longest, np.repeat(np.arange(rows), np.diff(cut)), size)
    ids, sha = np.zeros(rows, np.int64), [hashlib.sha256(b"").hexdigest()] * rows
    names = flat.field(0).to_pylist()
    for r in np.flatnonzero(np.diff(cut)):
        own = sorted(set(names[cut[r]:cut[r + 1]]))
        ids[r], sha[r] = len(own), hashlib.sha256(",".join(own).encode()).hexdigest()
    n_hit = hit[w.bound[1:]] - hit[w.bound[:-1]]
    return {"n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "n_items": pa.array(ids),
            "items_sha256": pa.array(sha, pa.string()), "contaminated": pa.array(n_hit > 0),
            "longest_match": pa.array(longest)}


def _test_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """Benchmark blocks, one at a time on the driver, each within ``block_bytes`` (or one item)."""
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
                            F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        if texts and size + len(r["t"]) > block_bytes:
            yield Suffixes(ids, texts, window)
            ids, texts, size = [], [], 0
        ids.append(r["i"])
        texts.append(r["t"])
        size += len(r["t"])
    yield Suffixes(ids, texts, window)


def _judged(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str, item_col: str,
            item_text_col: str, window: int, block_bytes: int) -> tuple[DataFrame, list[str]]:
    """The rows with their results, and the working names of the columns ``keep``."""
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    tests = [sc.broadcast(t) for t in _test_blocks(benchmark, item_col, item_text_col, window, block_bytes)]
    names = ["text" if c == text_col else f"k{i}" for i, c in enumerate(keep)]
    df = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names) if n != "text"], F.col(text_col).alias("text"))
    own, text = list(df.schema.fields[:-1]), df.schema.fields[-1]
    carried = [f.name for f in own]
    for i, t in enumerate(tests):
        last = i == len(tests) - 1
        out = own + ([text] if not last or "text" in names else []) + ([
            T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
            T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
            T.StructField("contaminated", T.BooleanType()), T.StructField("longest_match", T.LongType()),
        ] if last else []) + [T.StructField("matches", MATCHES)]
        df = df.mapInArrow(_scan(t, carried, bool(i), last, "text" in names), T.StructType(out))
    return df, names


RESULTS = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "matches"]


def verbatim_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: the columns ``keep``, n_words, n_hit (words inside a matching window),
    n_items, items_sha256, contaminated, longest_match (words) and matches (item, places, words)."""
    df, names = _judged(docs, benchmark, keep, text_col, item_col, item_text_col, window, block_bytes)
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *RESULTS)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; columns as given."""
    df, names = _judged(docs, benchmark, docs.columns, text_col, item_col, item_text_col, window, block_bytes)
    return df.filter("not contaminated").select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])


#: DuckDB SQL of the query: every window compared in plain text, matches joined along their diagonals.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, row_number() OVER () AS item, least(len(w), 10) AS k, w FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
win AS (SELECT item_id, item, k, start, array_to_string(w[start + 1:start + k], ' ') AS words
        FROM (SELECT *, unnest(range(len(w) - k + 1)) AS start FROM b WHERE k > 0)),
place AS (SELECT row_id, k, pos, array_to_string(w[pos + 1:pos + k], ' ') AS words FROM (
            SELECT row_id, w, k, unnest(range(len(w) - k + 1)) AS pos FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT row_id, item_id, item, k, pos, pos - start AS shift FROM place JOIN win USING (k, words)),
run AS (SELECT row_id, max(n) AS longest FROM (SELECT row_id, max(pos) - min(pos) + any_value(k) AS n FROM (
          SELECT *, pos - row_number() OVER (PARTITION BY row_id, item, shift ORDER BY pos) AS island FROM hit)
          GROUP BY row_id, item, shift, island) GROUP BY row_id),
covered AS (SELECT row_id, count(DISTINCT p) AS n_hit FROM (SELECT row_id, unnest(range(pos, pos + k)) AS p FROM hit) GROUP BY row_id),
items AS (SELECT row_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT row_id, item_id FROM hit) GROUP BY row_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest_match
FROM d LEFT JOIN covered USING (row_id) LEFT JOIN items USING (row_id) LEFT JOIN run USING (row_id)
"""
