"""Exact substring deduplication by bucket-pointer refinement.

All suffixes of all texts start in buckets of their first 8 bytes. A bucket identifier of a deeper
prefix is made from the identifiers at the place itself and at a later offset (8 to 16, 16 and 8 to
24, 24 to 48, 48 to 96, 96 and 96 four bytes on to 100), each level reusing the identifiers that the
level before has updated. Identifiers are 64-bit hashes of the pair, so that all tasks agree on them
without a central numbering, and the sorting that gathers a bucket is Spark's.

Sorting every suffix of the corpus would cost many times its size. Every string of ``length`` bytes
holds ``length - gram + 1`` grams, and the least gram identifier names one place in it (its anchor);
equal strings have equal anchors at equal offsets. So the places with one anchor form a run of
neighbouring suffixes that travels as one row: first it is bucketed by the anchor's gram, then, in
buckets of two or more, refined by the identifier of the whole run. Runs equal to an earlier run are
repeats as a whole. Where one gram bucket holds different runs, the first of each is opened: its bytes
are fetched and its suffixes refined one by one to full depth, in a task that holds the bucket, or by
Spark's sort where the bucket holds more than ``hot_runs`` runs.

Texts move only where places have to meet them: a fixed-size sieve (bitmap.py) keeps back documents
that certainly have none.

A task folds equal runs of its own rows into one row (with the places of the others) before the
shuffle, so that a passage in a third of the corpus is one row per task in its bucket.

A document is named by its id and 127 bits of hashes of its text, so that places and removals belong to
one text only. Documents are ordered by id, then by the hashes.

Defined cases: a null or empty text has no bytes; a null doc_id comes after all others; rows of one id (or
none) with different texts are different documents, in the order of the hashes; rows equal in id and
text are one document, of which every row loses the same; extra columns are ignored."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.bitmap import sieve, sieved
from quarry.llm.store import bounded_batches, materialize

LENGTH = 100
GRAM = 24
_U = np.uint64
_LAST = (1 << 63) - 1
#: Runs or suffixes that a task folds at a time.
FOLD = 1 << 20
#: Different runs in one gram bucket that a task refines by itself; larger buckets are sorted by Spark.
HOT_RUNS = 2048


def refined(ids: np.ndarray, later: int) -> np.ndarray:
    """Bucket identifiers refined by those at a later offset."""
    x = ids[:-later] * _U(0x9E3779B97F4A7C15)
    x += ids[later:]
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    return x


def gram_buckets(buf: np.ndarray) -> np.ndarray:
    """Identifiers of the first 8 bytes of every suffix."""
    n = max(len(buf) - 7, 0)
    x = np.empty(n, np.uint64)
    for k in range(min(8, n)):
        x[k::8] = np.frombuffer(buf[k:k + (len(buf) - k) // 8 * 8].tobytes(), "<u8")
    x += _U(W._BASE)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x


def deepen(ids: np.ndarray, have: int, want: int) -> np.ndarray:
    while have < want:
        step = min(have, want - have)
        ids, have = refined(ids, step), have + step
    return ids


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each window of ``width`` entries."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = np.minimum(x[:-step], x[step:]), have + step
    return x


class Buckets:
    """Identifiers of a block: grams, full-depth suffixes, and which suffixes are that long."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
        self.gram = deepen(gram_buckets(buf), 8, gram)
        self.full = deepen(self.gram, gram, length)
        self.inside = np.ones(len(self.full), bool)
        for end in offs[1:-1].tolist():
            self.inside[max(end - length + 1, 0):end] = False


def runs(buf: np.ndarray, offs: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram id, run id, first place, number of places, anchor's offset) of all runs of a block."""
    if len(buf) < length:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    b = Buckets(buf, offs, length, gram)
    order = b.gram & _U(0xFFFFFFFF00000000)
    order |= np.arange(len(order), dtype=np.uint64)  # ties: the first place
    anchor = _least(order, length - gram + 1) & _U(0xFFFFFFFF)
    turn = np.ones(len(anchor) + 1, bool)  # where a run ends before the place
    np.not_equal(anchor[1:], anchor[:-1], out=turn[1:-1])
    edge = b.inside[1:] != b.inside[:-1]
    turn[1:-1] |= edge
    at = np.flatnonzero(turn)
    first, last = at[:-1], at[1:] - 1
    ok = b.inside[first]
    first, last = first[ok], last[ok]
    anchor = anchor[first].astype(np.int64)
    shape = ((last - first) << 16 | (anchor - first)).astype(np.uint64)
    ident = W.mix(b.full[first] * _U(0x9E3779B97F4A7C15) + W.mix(b.full[last] + shape * _U(0xC2B2AE3D27D4EB4F)))
    return b.gram[anchor], ident, first, last - first + 1, anchor - first


#: Names a document: its id and two hashes of its text.
_KEY = ["doc", "va", "vb"]
_KEYS = "doc long, va long, vb long"
_FOLDED = f"k1 long, k2 long, {_KEYS}, place long, others binary"


def _keys(batch) -> np.ndarray:
    """The names of a batch's documents, a row each."""
    return np.stack([np.asarray(batch.column(c)) for c in _KEY], axis=1)


def _as_keys(keys: np.ndarray) -> dict:
    return {c: pa.array(np.ascontiguousarray(keys[:, i])) for i, c in enumerate(_KEY)}


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Each row's place in the order of names; equal names share one."""
    if not len(keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    head = keys[new]
    by = np.lexsort((head[:, 2], head[:, 1], head[:, 0]))
    rank = np.zeros(len(head), np.int64)
    rank[by[1:]] = np.cumsum((head[by[1:]] != head[by[:-1]]).any(axis=1))
    return rank[np.cumsum(new) - 1]


def _folded(k1, k2, keys, place) -> pa.RecordBatch:
    """One row for each (k1, k2): its first place, and the rest packed as (doc, va, vb, place) rows."""
    doc = _ranked(keys)
    by = np.lexsort((place, doc, k2, k1))
    k1, k2, doc, keys, place = k1[by], k2[by], doc[by], keys[by], place[by]
    again = np.zeros(len(k1), bool)  # the same place of a document whose row is repeated
    again[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1]) & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])
    k1, k2, keys, place = k1[~again], k2[~again], keys[~again], place[~again]
    new = np.ones(len(k1), bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(k1)))
    others = [None] * len(first)
    pairs = np.column_stack([keys, place])
    for i in np.flatnonzero(many > 1):
        others[i] = pairs[first[i] + 1:first[i] + many[i]].tobytes()
    as_long = lambda x: pa.array(x[first].view(np.int64) if x.dtype == np.uint64 else x[first])
    return pa.RecordBatch.from_pydict({"k1": as_long(k1), "k2": as_long(k2), **_as_keys(keys[first]), "place": as_long(place),
                                       "others": pa.array(others, pa.binary())})


def _fold(parts):
    """Fold (k1, k2, keys, place) pieces, FOLD entries at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= FOLD:
            yield _folded(*[np.concatenate(x) for x in zip(*held)])
            held, n = [], 0
    if n:
        yield _folded(*[np.concatenate(x) for x in zip(*held)])


def _run_rows(length: int, gram: int):
    def parts(batches):
        for batch in batches:
            docs = _keys(batch)
            for lo, hi, buf, offs in W.blocks(batch.column("text")):
                g, ident, first, many, to_anchor = runs(buf, offs, length, gram)
                d = np.searchsorted(offs, first, side="right") - 1
                yield g, ident, docs[lo:hi][d], (first - offs[d]) << 24 | many << 12 | to_anchor
    return lambda batches: _fold(parts(batches))


def _places(batches):
    """Unfold: every place of a repeated bucket; the others of a folded row are removed as a whole."""
    for batch in batches:
        packed = batch.column("others").to_pylist()
        pairs = np.frombuffer(b"".join(p for p in packed if p), np.int64).reshape(-1, 4)
        heads = batch.select(["k1", *_KEY, "place", "repeat", "open", "hot"])
        yield heads.filter(pc.or_(batch.column("repeat"), batch.column("open")))
        for lo in range(0, len(pairs), FOLD):
            part = pairs[lo:lo + FOLD]
            no = np.zeros(len(part), bool)
            yield pa.RecordBatch.from_pydict({
                "k1": pa.array(np.zeros(len(part), np.int64)), **_as_keys(part), "place": pa.array(np.ascontiguousarray(part[:, 3])),
                "repeat": pa.array(~no), "open": pa.array(no), "hot": pa.array(no)})


def _judged(folded: DataFrame, hot_runs: int) -> DataFrame:
    """Places (k1, doc, va, vb, place, repeat, open, hot) of the buckets that hold more than one row or place.
    repeat: equal to an earlier one; open: the first of its kind in a bucket of several kinds; hot: the
    bucket has more than ``hot_runs`` of those."""
    bucket, exact = Window.partitionBy("k1"), Window.partitionBy("k1", "k2")
    here = F.struct(*_KEY, "place")
    return (folded.withColumn("lo", F.min("k2").over(bucket)).withColumn("hi", F.max("k2").over(bucket))
            .withColumn("first", F.min(here).over(exact))
            .withColumn("repeat", here != F.col("first"))
            .withColumn("open", ~F.col("repeat") & (F.col("lo") < F.col("hi")))
            .withColumn("hot", F.sum(F.col("open").cast("int")).over(bucket) > hot_runs)
            .filter("repeat or open or others is not null")
            .select("k1", *_KEY, "place", "others", "repeat", "open", "hot")
            .mapInArrow(_places, f"k1 long, {_KEYS}, place long, repeat boolean, open boolean, hot boolean"))


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, (place >> 12) & 0xFFF, place & 0xFFF


def _segments(length: int):
    """The bytes of the open runs of each document; neighbouring rows of one document give them once."""
    def run(batches):
        last = None
        for batch in batches:
            buf, offs = W.raw(batch.column("text"))
            keys, out = _keys(batch), [[], [], [], [], []]
            for i, ps in enumerate(batch.column("places").to_pylist()):
                key, before = tuple(keys[i]), last
                last = key
                if key == before:
                    continue
                text = buf[offs[i]:offs[i + 1]].tobytes()
                for p in ps:
                    first, many = p["place"] >> 24, (p["place"] >> 12) & 0xFFF
                    for x, v in zip(out, (p["k1"], p["hot"], i, p["place"], text[first:first + many - 1 + length])):
                        x.append(v)
            yield pa.RecordBatch.from_pydict({"k1": pa.array(out[0], pa.int64()), "hot": pa.array(out[1], pa.bool_()),
                                              **_as_keys(keys[np.array(out[2], np.int64)]), "place": pa.array(out[3], pa.int64()),
                                              "bytes": pa.array(out[4], pa.binary())})
    return run


_OPENED = f"{_KEYS}, first long, many long, k1 long, k2 long"


def _refine(length: int, gram: int):
    """Rows sorted by bucket, document and place. Buckets of a bounded number of runs are refined here
    to full depth and give their repeated places; the suffixes of hot ones go on to be sorted."""
    def solved(k1, hot, keys, place, column):
        doc = _ranked(keys)
        done = np.flatnonzero(~hot)
        first, many, to_anchor = _unpacked(place)
        for part in (done, np.flatnonzero(hot)):
            if not len(part):
                continue
            buf, offs = W.raw(column.take(pa.array(part)))
            b = Buckets(buf, offs, length, gram)
            n = many[part]
            row = np.repeat(part, n)
            p = first[row] + W.ragged(n)
            full, d = b.full[b.inside], doc[row]
            if part is not done:
                g = np.repeat(b.gram[offs[:-1] + to_anchor[part]], n)
                yield {**_as_keys(keys[row]), "first": p, "many": np.ones(len(p), np.int64), "k1": full.view(np.int64), "k2": g.view(np.int64)}
                continue
            key = W.mix(full + k1[row].view(np.uint64) * _U(W._BASE))
            order = np.lexsort((p, d, key))
            new = np.ones(len(order), bool)
            new[1:] = key[order][1:] != key[order][:-1]
            least = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            again = np.zeros(len(order), bool)
            again[order] = (d[order] != d[least]) | (p[order] != p[least])
            start = again.copy()
            start[1:] &= ~again[:-1] | (row[1:] != row[:-1])
            stop = again.copy()
            stop[:-1] &= ~again[1:] | (row[1:] != row[:-1])
            a, z = np.flatnonzero(start), np.flatnonzero(stop)
            yield {**_as_keys(keys[row[a]]), "first": p[a], "many": z - a + 1, "k1": np.zeros(len(a), np.int64), "k2": np.zeros(len(a), np.int64)}

    def run(batches):
        held = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                k = np.asarray(batch.column("k1"))
                cut = int(np.searchsorted(k, k[-1], side="left"))  # the last bucket may go on in the next batch
                if np.asarray(batch.column("hot"))[-1]:
                    cut = batch.num_rows
                if cut or held[0].num_rows and k[-1] != held[0].column("k1")[0].as_py():
                    rest, held[-1] = batch.slice(cut), batch.slice(0, cut)
                    yield from _ripe(held, solved)
                    held = [rest] if rest.num_rows else []
        if held:
            yield from _ripe(held, solved)
    return run


def _ripe(held, solved):
    t = pa.Table.from_batches(held).combine_chunks()
    column = lambda c: np.asarray(t.column(c))
    data = t.column("bytes")
    data = data.chunk(0) if data.num_chunks else pa.array([], pa.binary())
    for out in solved(column("k1"), column("hot"), _keys(t), column("place"), data):
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in out.items()})


def _refold(batches):
    return _fold((np.asarray(b.column("k1")).view(np.uint64), np.asarray(b.column("k2")).view(np.uint64),
                  _keys(b), np.asarray(b.column("first"))) for b in batches)


def _digests(length: int, with_text: bool):
    """Documents with the places to remove: (first place, number of places) pairs."""
    def run(batches):
        for batch in batches:
            buf, offs = W.raw(batch.column("text"))
            out = []
            for i, ps in enumerate(batch.column("places").to_pylist()):
                text, ps = buf[offs[i]:offs[i + 1]], ps or ()
                first = np.array([p["first"] for p in ps], np.int64)
                past = first + np.array([p["many"] for p in ps], np.int64) - 1 + length
                cover = np.zeros(len(text) + 1, np.int64)
                np.add.at(cover, np.minimum(first, len(text)), 1)
                np.add.at(cover, np.minimum(past, len(text)), -1)
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.diff(gone.astype(np.int8), prepend=0)
                kept = text[~gone].tobytes()
                out.append((len(text), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest(),
                            kept.decode("utf-8", "replace") if with_text else None))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **{
                k: pa.array(c, pa.string() if k.startswith("kept") else pa.int64()) for k, c in zip(_RESULT, cols)}})
    return run


_RESULT = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                        gram: int = GRAM, with_text: bool = True, hot_runs: int = HOT_RUNS) -> DataFrame:
    """Per row: the id, n_bytes, n_removed, n_spans, kept_sha256 and (``with_text``) the kept text, in
    which a character that lost some of its bytes is U+FFFD (the digest is of the bytes themselves).
    ``length`` is under 2,048 and ``gram`` at least 8."""
    if not 8 <= gram < length < 2048:
        raise ValueError("8 <= gram < length < 2048")
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sign of va puts a document without an id after the one whose id is the last
    va = F.shiftrightunsigned(F.xxhash64("text"), 1)
    keyed = (texts.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST)))
             .withColumn("va", F.when(F.col("doc_id").isNull(), va).otherwise(F.bitwise_not(va)))
             .withColumn("vb", F.xxhash64(F.lit(1), "text")).withColumn("who", F.xxhash64(*_KEY)))
    found = materialize(_judged(keyed.select(*_KEY, "text").mapInArrow(_run_rows(length, gram), _FOLDED), hot_runs), "places")

    opened = found.filter("open").withColumn("who", F.xxhash64(*_KEY))
    by_doc = opened.groupBy(*_KEY).agg(F.collect_set(F.struct("k1", "place", "hot")).alias("places"))
    holders = sieved(keyed, "who", sieve(opened, "who")).filter("may_have")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64(*_KEY, "place"), F.lit(64))).otherwise(F.lit(0))
    segments = (holders.join(by_doc, _KEY).select(*_KEY, "text", "places")
                .mapInArrow(_segments(length), f"k1 long, hot boolean, {_KEYS}, place long, bytes binary")
                .repartition("k1", salt).sortWithinPartitions("k1", *_KEY, "place"))
    refined_ = materialize(segments.mapInArrow(_refine(length, gram), _OPENED), "refined")
    unsolved = _judged(refined_.filter("k1 != 0 or k2 != 0").mapInArrow(_refold, _FOLDED), hot_runs)

    gone = materialize(
        found.filter("repeat").select(*_KEY, F.shiftright("place", 24).alias("first"),
                                      F.shiftright("place", 12).bitwiseAND(0xFFF).alias("many"))
        .union(refined_.filter("k1 = 0 and k2 = 0").select(*_KEY, "first", "many"))
        .union(unsolved.filter("repeat").select(*_KEY, F.col("place").alias("first"), F.lit(1).cast("long").alias("many"))), "gone")
    touched = sieved(keyed, "who", sieve(gone.withColumn("who", F.xxhash64(*_KEY)), "who"))
    whole = touched.filter("not may_have").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").alias("kept"))
    by_doc = gone.groupBy(*_KEY).agg(F.collect_set(F.struct("first", "many")).alias("places"))
    cut = (touched.filter("may_have").join(by_doc, _KEY, "left").select("doc_id", "text", "places")
           .mapInArrow(_digests(length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"))
    out = whole.union(cut).withColumnRenamed("doc_id", id_col)
    return out if with_text else out.drop("kept")
