"""MinHash near-deduplication with HyperMinHash registers.

Each document's distinct shingles are hashed once; the top of the hash names one of the registers
and the least remainder in it is kept as a leading-zero count plus mantissa bits (16 bits). An
empty register borrows from the occupied one that comes first in its own fixed random order, so
short documents fill all registers too. Registers are banded; documents that share a band are
candidates. A collision-corrected estimate from the registers drops hopeless pairs, and the full
shingle sets decide the rest.

Copies collapse first: documents with one shingle set are one class, told by two 64-bit sums over
the set. Registers are written once, for the first row of a class that a task meets, and that row's number stands
for the class. Links are sought between classes only. Band keys are counted first; the second pass drops, by a
bitmap of the keys that are shared, those that no other class has, before they are shuffled. In each bucket a
hub (the member that meets most others over all bands) is compared with every other member: as many pairs as
members. Hubs meet their members in groups of a bounded number, sorted so that the hub comes first; a task holds
one hub's registers or set at a time.

Two members of one bucket have met at its hub. Where the hub's links leave members of a hub in several
components, those are compared with each other in blocks of a bounded number of members and bytes, inside tasks:
first by the low bytes of their registers, which names the members that need their sets, then by the sets. Only
confirmed links leave the tasks, and no link that could join two components is left out. Scratch tables go when
their last reader is done.

With 72 bands of 8 registers a pair of similarity 0.8 shares no band with probability 2e-6, one of
0.1 shares some with 7e-7. The estimate's standard error is 0.017 at 0.8; pairs estimated under
0.7 are dropped.

Defined cases: null or empty texts and texts without words have no shingles and link with nothing;
a text of fewer words than a shingle is one shingle; rows of one doc_id with different texts are documents of their
own, each grouped by its own text; a null doc_id is kept and stays out of all groups; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.bitmap import among, low_bits, sieve, sieved
from quarry.llm.components import components
from quarry.llm.store import bounded_batches, materialize, release

BANDS, ROWS = 72, 8
REGISTERS = BANDS * ROWS
MANTISSA = 10
ZEROS = 53
LEAST_ESTIMATE = 0.7
#: Members of a hub that are compared with each other at a time, and the bytes of their sets.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Members that meet one copy of their hub.
STAR = 512
#: Sets that a task remembers to have written registers of.
REMEMBERED = 1 << 18

_U = np.uint64
_WIDTH = (1 << 64) // REGISTERS
_EDGES = (np.arange(REGISTERS, dtype=np.uint64) * _U(_WIDTH))
#: The order in which each register, if empty, looks at the others.
_ORDER = W.mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + _U(12345)).reshape(REGISTERS, REGISTERS)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    w = W.words(W.LOWER[buf], offs, W.SPACED)
    at, h = W.grams(w, k)
    cut = np.searchsorted(at, w.bound)
    out = []
    for d in range(len(offs) - 1):
        n = w.bound[d + 1] - w.bound[d]
        if n >= k:
            out.append(np.unique(h[cut[d]:cut[d + 1]]))
        elif n:
            one = _U(n)
            for x in w.ident[w.bound[d]:w.bound[d + 1]]:
                one = W.mix(np.array([one ^ x]))[0]
            out.append(np.array([one], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(s: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted, non-empty set of 64-bit hashes."""
    first = np.searchsorted(s, _EDGES)
    full = np.append(first[1:], len(s)) > first
    at = np.flatnonzero(full)
    x = (s[first[at]] - _EDGES[at]) * _U(REGISTERS)
    zeros = np.minimum(64 - np.frexp(x.astype(np.float64))[1], ZEROS).clip(0)
    bits = (x << (zeros + 1).astype(np.uint64)) >> _U(64 - MANTISSA)
    out = np.empty(REGISTERS, np.uint16)
    out[at] = (zeros << MANTISSA) | bits.astype(np.int64)
    if len(at) < REGISTERS:
        hole = np.flatnonzero(~full)
        out[hole] = out[at[_ORDER[hole[:, None], at].argmin(axis=1)]]
    return out


def _sketches(k: int):
    def run(batches):
        met: set = set()
        for batch in batches:
            named, col = batch.column(0).is_valid().to_numpy(zero_copy_only=False), batch.column(2)
            for lo, hi, buf, offs in W.blocks(col):
                sets = shingle_sets(buf, offs, k)
                n = np.array([len(s) for s in sets], np.int64)
                mark = np.array([[W.mix(s).sum(dtype=np.uint64), W.mix(s ^ _U(W._BASE)).sum(dtype=np.uint64)] for s in sets],
                                np.uint64).reshape(-1, 2).view(np.int64)
                sketch: list = [None] * len(sets)
                for i, m in enumerate(map(tuple, mark.tolist())):
                    if n[i] and named[lo + i] and m not in met:
                        sketch[i] = registers(sets[i]).tobytes()
                        if len(met) >= REMEMBERED:
                            met.clear()
                        met.add(m)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, hi - lo) for c in (0, 1)), pa.array(n), pa.array(mark[:, 0]), pa.array(mark[:, 1]),
                     pa.array([s is not None for s in sketch], pa.bool_()), pa.array(sketch, pa.binary())],
                    names=["doc_id", "t", "n_shingles", "h1", "h2", "holds", "sketch"])
    return run


def _bands(shared=None):
    """(key, rep, n) of every band; those only whose key may be shared, if ``shared`` has the bits of such keys."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            reg = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), reg.shape[:2]).copy()
            for r in range(ROWS):
                key = W.mix(key * _U(W._BASE) + reg[:, :, r])
            key = key.ravel()
            some = np.arange(len(key)) if shared is None else np.flatnonzero(among(shared.value, key))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(key[some].view(np.int64)), "rep": pa.array(np.asarray(batch.column("rep"))[some // BANDS]),
                "n": pa.array(np.asarray(batch.column("n"))[some // BANDS])})
    return run


def chance_collision(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that unrelated sets of these sizes agree in a register: for every leading-zero
    count, both least values lie there and share the mantissa."""
    out = np.zeros(len(n_a))
    ka, kb = (np.maximum(1.0, n / REGISTERS) for n in (n_a, n_b))
    for z in range(ZEROS + 1):
        lo, hi = 2.0 ** -(z + 1), 2.0 ** -z
        out += ((1 - lo) ** ka - (1 - hi) ** ka) * ((1 - lo) ** kb - (1 - hi) ** kb)
    return out / 2 ** MANTISSA


def _runs(batch, columns) -> list[tuple[tuple, int, int]]:
    """(key, first row, past the last) of the runs of rows that are equal in the whole-number columns."""
    if not batch.num_rows:
        return []
    k = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in columns], axis=1)
    edges = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
    return [(tuple(k[a].tolist()), a, z) for a, z in zip(edges, edges[1:])]


def _estimated(least: float):
    """Pairs (hub, member) whose registers let them be similar enough."""
    def run(batches):
        group, own, size = None, None, 0
        for batch in batches:
            found: list = [[], []]
            for key, a, z in _runs(batch, ("hub", "part")):
                reg = np.frombuffer(b"".join(batch.column("data").slice(a, z - a).to_pylist()), np.uint16).reshape(-1, REGISTERS)
                n = np.asarray(batch.column("n").slice(a, z - a)).astype(float)
                rep = np.asarray(batch.column("rep").slice(a, z - a))
                if key != group:  # the hub's own row comes first
                    group, own, size = key, reg[0].copy(), n[0]
                p = chance_collision(np.full(len(n), size), n)
                ok = (((reg == own).mean(axis=1) - p) / (1 - p) >= least) & (rep != key[0])
                found[0] += [key[0]] * int(ok.sum())
                found[1] += rep[ok].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])
    return run


def _text_sets(column, k: int) -> list[np.ndarray]:
    return [s for _, _, buf, offs in W.blocks(column) for s in shingle_sets(buf, offs, k)]


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(percent: int, k: int):
    """Pairs (hub, member) whose whole sets are similar enough."""
    def run(batches):
        group, own = None, None
        for batch in batches:
            found: list = [[], []]
            for key, a, z in _runs(batch, ("hub", "part")):
                sets, rep = _text_sets(batch.column("data").slice(a, z - a), k), np.asarray(batch.column("rep").slice(a, z - a)).tolist()
                if key != group:
                    group, own = key, sets[0]
                for s, r in zip(sets, rep):
                    if r != key[0] and _linked(own, s, percent):
                        found[0].append(key[0])
                        found[1].append(r)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])
    return run


def _stars(pairs: DataFrame) -> DataFrame:
    """(rep, hub, part, side) of all ends of pairs (a: hub, b): the members of a hub (side 1) in parts of about STAR,
    the hub itself (side 0) once in each part."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    dealt = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    return (dealt.select(F.col("b").alias("rep"), F.col("a").alias("hub"), "part", F.lit(1).alias("side"))
            .union(dealt.select("a", "a", "part", F.lit(0)).distinct()))


def _starred(ends: DataFrame, data: DataFrame, compare) -> DataFrame:
    """Links that ``compare`` finds between hubs and their members. data: (rep, data) and more."""
    return (ends.join(data, "rep").repartition("hub", "part").sortWithinPartitions("hub", "part", "side", "rep")
            .mapInArrow(compare, "a long, b long"))


class _Classes:
    """The rows of a table with the marks of their sets, and its classes."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int):
        bounded_batches(docs.sparkSession)
        self.k = k
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text"))
        shape = "doc_id long, t long, n_shingles long, h1 long, h2 long, holds boolean, sketch binary"
        self.rows = materialize(self.texts.mapInArrow(_sketches(k), shape).withColumn("node", F.monotonically_increasing_id()), "sketches")
        grouped = self.rows.filter("n_shingles > 0 and doc_id is not null")
        self.classes = materialize(grouped.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "t")).alias("first"),
                                                                   F.min(F.when(F.col("holds"), F.col("node"))).alias("rep")), "classes")
        self.held = self.rows.filter("holds").select(F.col("node").alias("rep"), F.col("n_shingles").cast("int").alias("n"), "sketch")
        #: Rows that hold registers of a class which another row stands for.
        self.other = (self.rows.filter("holds").select("node", "h1", "h2").join(self.classes, ["h1", "h2"]).filter("node != rep")
                      .select("node", F.col("rep").alias("own")))

    def sketches(self, ends: DataFrame) -> DataFrame:
        """(rep, n, data) of the classes among ``ends``; only rows that pass a sieve move."""
        return sieved(self.held, "rep", sieve(ends, "rep")).filter("may_have").select("rep", "n", F.col("sketch").alias("data"))

    def sets(self, ends: DataFrame) -> DataFrame:
        """(rep, data) of the classes among ``ends``, data a text that has the class's set."""
        at = materialize(ends.select("rep").distinct().join(self.rows.select(F.col("node").alias("rep"), "doc_id", "t"), "rep")
                         .withColumn("k", F.xxhash64("doc_id", "t")), "places")
        some = sieved(self.texts.withColumn("k", F.xxhash64("doc_id", "t")), "k", sieve(at, "k")).filter("may_have")
        return some.drop("may_have").join(at, ["k", "doc_id", "t"]).select("rep", F.col("text").alias("data"))


def _candidates(of: _Classes) -> DataFrame:
    """(key, rep, n, c, hub, hub_n): the members of shared band buckets beside their hub."""
    shape = "key long, rep long, n int"
    shared = materialize(of.held.mapInArrow(_bands(), shape).groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "shared")
    bits = of.held.sparkSession.sparkContext.broadcast(low_bits(shared, "key"))
    met = of.held.mapInArrow(_bands(bits), shape).join(shared, "key")
    met = met.join(of.other.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("own", "rep").alias("rep"), "n").distinct()
    met = materialize(met, "buckets")
    cand = met.join(met.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key")
    most = cand.groupBy("rep").agg(F.sum("c").alias("met"))
    hubs = (cand.join(most, "rep").groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("minus"), "n")).alias("h"))
            .select("key", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n")))
    out = materialize(cand.join(hubs, "key").filter("rep != hub").select("rep", "n", "c", "hub", "hub_n"), "hubs")
    release(shared, met)
    return out


def _links(of: _Classes, percent: int) -> DataFrame:
    """Confirmed links (a, b) between classes, enough to join all that links can join."""
    cand = _candidates(of)
    first = (cand.filter(f"100L * least(n, hub_n) >= {percent}L * greatest(n, hub_n)")
             .select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    ends = materialize(_stars(first), "ends")
    near = materialize(_starred(ends, of.sketches(ends), _estimated(LEAST_ESTIMATE)), "estimated")
    stars = materialize(_stars(near), "ends")
    links = materialize(_starred(stars, of.sets(stars), _confirmed(percent, of.k)), "links")
    release(ends, near, stars)

    joined = components(links).select(F.col("node").alias("rep"), "component")
    met_at = (cand.filter("c > 2").select("hub", "rep", "n").distinct().join(joined, "rep", "left")
              .withColumn("component", F.coalesce("component", "rep")))
    split = met_at.groupBy("hub").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("hub")
    open_ = materialize(met_at.join(split, "hub"), "open")
    release(cand)
    low = of.sketches(open_).select("rep", "data").mapInArrow(_low_bytes, "rep long, data binary")
    plausible = materialize(_paired(open_, REGISTERS, low, _plausible, "hub long, rep long").distinct(), "plausible")
    rest = open_.join(plausible, ["hub", "rep"], "left_semi")
    rest = materialize(_paired(rest, F.col("n") * 8, of.sets(plausible), _rest_links(percent, of.k), "a long, b long").distinct(), "rest")
    release(open_, plausible)
    return links.union(rest)


def _grouped_rows(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """Per row: doc_id, t (hash of its text), n_shingles, and first, the least (doc_id, t) of its component (null
    for rows without an id or shingles)."""
    of = _Classes(docs, id_col, text_col, k)
    linked = components(_links(of, percent)).join(of.classes.select(F.col("rep").alias("node"), "h1", "h2", "first"), "node")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    moved = materialize(linked.join(least, "component").select("h1", "h2", "least"), "moved")
    final = of.classes.join(moved, ["h1", "h2"], "left").select("h1", "h2", F.coalesce("least", "first").alias("first"))
    marks = of.rows.select("doc_id", "t", "n_shingles", "h1", "h2")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return marks.join(final, ["h1", "h2"], "left").select("doc_id", "t", "n_shingles", F.when(~alone, F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per row: the id, n_shingles, component_id (smallest id reachable over links of at least
    ``percent`` similarity of the shingle sets) and kept (the id is its component's)."""
    return (_grouped_rows(docs, id_col, text_col, shingle, percent)
            .select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _low_bytes(batches):
    for batch in batches:
        low = [np.frombuffer(x, np.uint16).astype(np.uint8).tobytes() for x in batch.column("data").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(low, pa.binary())], names=["rep", "data"])


def _paired(members: DataFrame, size, data: DataFrame, compare, shape: str) -> DataFrame:
    """Compare the members (hub, rep, n, component) that met at one hub, in pairs of blocks: a hub's members are
    dealt to blocks of about BLOCK members and BLOCK_BYTES (``size`` bytes each), and every two blocks meet in one
    bounded group."""
    size = size if not isinstance(size, int) else F.lit(size)
    many = members.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int").alias("blocks"))
    dealt = (members.join(many, "hub").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))
    rows = dealt.join(data, "rep").select("hub", "i", "j", "rep", "component", "own", "data")
    return (rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "rep").mapInArrow(_grouped(compare), shape))


def _grouped(compare):
    """Runs of equal (hub, i, j), which may cross batches, to ``compare``."""
    def run(batches):
        held, group = [], None
        for batch in batches:
            for key, a, z in _runs(batch, ("hub", "i", "j")):
                if group is not None and key != group:
                    yield from compare(group, pa.Table.from_batches(held))
                    held = []
                group = key
                held.append(batch.slice(a, z - a))
        if held:
            yield from compare(group, pa.Table.from_batches(held))
    return run


def _open_pairs(component: np.ndarray, own: np.ndarray, across: bool, fits):
    """(row, later rows) of other components that ``fits``."""
    for a in range(len(component) - 1):
        ok = component[a + 1:] != component[a]
        if across:
            ok &= own[a + 1:] != own[a]  # pairs inside a block meet in the block's own group
        b = np.flatnonzero(ok) + a + 1
        if len(b):
            b = b[fits(a, b)]
        if len(b):
            yield a, b


def _plausible(key, t):
    """The members that agree with one of another component in the low bytes of enough registers. Registers that are
    equal are so in their low bytes, so no pair that its estimate would keep is missed."""
    if t.num_rows < 2:
        return
    low = np.frombuffer(b"".join(t.column("data").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    rep, component, own = (np.asarray(t.column(c)) for c in ("rep", "component", "own"))
    some = np.zeros(len(rep), bool)
    for a, b in _open_pairs(component, own, key[1] != key[2], lambda a, b: (low[b] == low[a]).mean(axis=1) >= LEAST_ESTIMATE):
        some[a] = some[b] = True
    if some.any():
        yield pa.RecordBatch.from_pydict({"hub": pa.array(np.full(int(some.sum()), key[0])), "rep": pa.array(rep[some])})


def _rest_links(percent: int, k: int):
    def compare(key, t):
        if t.num_rows < 2:
            return
        sets = _text_sets(t.column("data"), k)
        reg, n = np.stack([registers(s) for s in sets]), np.array([float(len(s)) for s in sets])
        rep, component, own = (np.asarray(t.column(c)) for c in ("rep", "component", "own"))
        root = {int(c): int(c) for c in component}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def fits(a, b):
            p = chance_collision(np.full(len(b), n[a]), n[b])
            return (100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a])) & (((reg[b] == reg[a]).mean(axis=1) - p) / (1 - p) >= LEAST_ESTIMATE)

        found: list = [[], []]
        for a, later in _open_pairs(component, own, key[1] != key[2], fits):
            for b in later:
                x, y = find(int(component[a])), find(int(component[b]))
                if x != y and _linked(sets[a], sets[b], percent):
                    root[x] = y
                    found[0].append(int(rep[a]))
                    found[1].append(int(rep[b]))
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])
    return compare


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                 percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the row of the smallest id (of several texts of it, the one whose hash is
    least), once. Rows that repeat both id and text count as one; columns as given. Only rows that pass a sieve of
    those in question move."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    mark = ["own_k", "own_id", "own_t"]
    rows = docs.toDF(*names).withColumn("own_id", F.col(key).cast("long")).withColumn("own_t", F.xxhash64(text)) \
        .withColumn("own_k", F.xxhash64("own_id", "own_t"))
    found = _grouped_rows(docs, id_col, text_col, shingle, percent)
    gone = materialize(found.filter(F.col("first").isNotNull() & ((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.t") != F.col("t"))))
                       .select(F.xxhash64("doc_id", "t").alias("own_k"), F.col("doc_id").alias("own_id"), F.col("t").alias("own_t")).distinct(), "gone")
    twice = rows.filter("own_id is not null").groupBy(*mark).count().filter("count > 1").select(*mark)
    seen = sieved(rows, "own_k", sieve(gone.union(twice), "own_k"))
    clear = seen.filter("not may_have or own_id is null").select(*names)
    rest = seen.filter("may_have and own_id is not null").join(gone, mark, "left_anti").dropDuplicates(mark).select(*names)
    return clear.union(rest).toDF(*docs.columns)


#: DuckDB SQL of the query (two-word shingles, 80 percent): every two classes of equal sets that share a shingle are compared.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT row_id, doc_id, list_distinct(CASE WHEN len(w) = 1 THEN w
        ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingles FROM d),
c AS (SELECT dense_rank() OVER (ORDER BY list_sort(shingles)) AS class, row_id, doc_id, len(shingles) AS n, shingles FROM s),
k AS (SELECT class, any_value(n) AS n, any_value(shingles) AS shingles FROM c WHERE n > 0 AND doc_id IS NOT NULL GROUP BY class),
u AS (SELECT class, n, unnest(shingles) AS shingle FROM k),
link AS (SELECT a.class AS x, b.class AS y FROM u a JOIN u b ON a.shingle = b.shingle AND a.class <> b.class
           AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
         GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT class AS x, class AS y FROM k UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
least_id AS (SELECT reach.x AS class, min(c.doc_id) AS component FROM reach JOIN c ON c.class = reach.y GROUP BY reach.x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 OR doc_id IS NULL THEN doc_id ELSE component END AS component_id,
       coalesce(n = 0 OR doc_id = component, true) AS kept
FROM c LEFT JOIN least_id USING (class)
"""
