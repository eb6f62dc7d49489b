"""Ranked lexical search by bag deduplication.

Documents are restricted to the vocabulary of the items: what is left of one is its vector of (term, occurrences)
and m, which its length gives. Documents equal in both are one class: rows are hashed and, where the hash is
the same, compared by their whole vectors. Every class is scored once against all items. Only the ``k`` best
classes of an item (ties by their smallest doc_id) can hold one of its ``k`` best documents, since each class
before another gives a document that comes first; those few classes are expanded to members by ascending doc_id, of
which ``k`` each are enough.

The items are taken in blocks of a bounded number of bytes (ITEM_BYTES, dealt by a hash of the id); a block's terms and
postings are broadcast, so what tasks hold does not grow with documents or items. A task keeps the ``k`` best classes
of each item that it has met and sends only those.

Scores are whole numbers: a term's weight w is floor(1000 ln((2 N + 2) / (2 df + 1))), and a document adds
w * (10^9 tf div (1000 tf + 8 m)) for each of the item's terms, with m = 10 + 90 n N div L.

Defined cases: a null or empty text has no terms and is never ranked; rows that repeat a doc_id are documents each,
and may take several ranks; null doc_ids come last among equal scores; rows that repeat an item_id are one item with the
terms of all; a null item_id is an item; items without terms, or whose terms no document holds, return nothing;
empty tables give no rows; extra columns are ignored."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import words as W
from quarry.llm.bitmap import sieve, sieved
from quarry.llm.store import bounded_batches, materialize

#: Item texts that are searched for at a time, about.
ITEM_BYTES = 4 << 20
#: Scores (classes times items) that a task works on at a time.
CELLS = 1 << 21


class Items:
    """The terms of a block of items: sorted identifiers, and for each term the items that hold it."""

    def __init__(self, ids: list, texts: list):
        self.ids = sorted(set(ids), key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(self.ids)}
        buf, offs = W.raw(pa.array(texts, pa.string()))
        w = W.words(W.LOWER[buf], offs, W.LETTERED)
        owner = np.array([number[x] for x in ids], np.int64)[w.doc]
        self.terms, term = np.unique(w.ident, return_inverse=True)
        pair = np.unique(term * max(len(self.ids), 1) + owner)
        self.item = pair % max(len(self.ids), 1)
        self.cut = np.searchsorted(pair // max(len(self.ids), 1), np.arange(len(self.terms) + 1))


def _vectors(items):
    """Per document: id, number of terms, and (term, occurrences) pairs of 32 bits by ascending term."""
    def run(batches):
        terms = items.value.terms
        for batch in batches:
            for lo, hi, buf, offs in W.blocks(batch.column(1)):
                w = W.words(W.LOWER[buf], offs, W.LETTERED)
                near = np.minimum(np.searchsorted(terms, w.ident), len(terms) - 1)
                some = np.flatnonzero(terms[near] == w.ident)
                key, tf = np.unique(w.doc[some] * len(terms) + near[some], return_counts=True)
                pairs = np.stack([key % len(terms), tf], axis=1).astype(np.uint32)
                cut = np.searchsorted(key // len(terms), np.arange(hi - lo + 1)) * 8
                vec = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(pairs.tobytes())])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(lo, hi - lo), "n": pa.array(np.diff(w.bound)), "vec": vec})
    return run


def _pairs(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of a column of vectors."""
    buf, offs = W.raw(column)
    pairs = np.frombuffer(buf.tobytes(), np.uint32).reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs) // 8), pairs[:, 0], pairs[:, 1]


def _holders(size: int):
    """Documents that hold each term, counted per task."""
    def run(batches):
        count = np.zeros(size, np.int64)
        for batch in batches:
            count += np.bincount(_pairs(batch.column(0))[1], minlength=size)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some.astype(np.int32)), "df": pa.array(count[some])})
    return run


def _best(items, weight, k: int):
    """The k best classes of each item in a partition: those of the highest scores, then of the smallest doc_ids."""
    def run(batches):
        own, w = items.value, weight.value
        many = len(own.ids)
        rows = max(1, CELLS // max(many, 1))
        item, score, first, m, vec = (np.zeros(0, np.int64) for _ in range(5))  # vec: places in held
        held: list = []
        floor = np.ones(many, np.int64)  # below it a score cannot enter
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                row, term, tf = _pairs(part.column("vec"))
                part_m = np.asarray(part.column("m"))
                part_first = np.asarray(part.column("first").fill_null(np.iinfo(np.int64).max))
                gain = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * part_m[row]))
                size = own.cut[term + 1] - own.cut[term]
                at = np.repeat(row * many, size) + own.item[np.repeat(own.cut[term], size) + W.ragged(size)]
                total = np.zeros(part.num_rows * many, np.int64)
                np.add.at(total, at, np.repeat(gain, size))
                total = total.reshape(-1, many)
                r, i = np.nonzero(total >= floor)
                if not len(r):
                    continue
                used, back = np.unique(r, return_inverse=True)
                vec = np.append(vec, len(held) + back)
                held += part.column("vec").take(pa.array(used)).to_pylist()
                item, score = np.append(item, i), np.append(score, total[r, i])
                first, m = np.append(first, part_first[r]), np.append(m, part_m[r])
                order = np.lexsort((first, -score, item))
                start = np.searchsorted(item[order], np.arange(many + 1))
                rank = np.arange(len(order)) - start[item[order]]
                order = order[rank < k]
                item, score, first, m, vec = (x[order] for x in (item, score, first, m, vec))
                kept, vec = np.unique(vec, return_inverse=True)
                held = [held[j] for j in kept]
                full = np.bincount(item, minlength=many) >= k
                lowest = np.searchsorted(item, np.arange(many), side="right") - 1
                floor[full] = score[lowest[full]]
        if len(item):
            big = np.iinfo(np.int64).max
            yield pa.RecordBatch.from_pydict({
                "item": pa.array(item.astype(np.int32)), "score": pa.array(score), "first": pa.array(first, mask=first == big),
                "m": pa.array(m), "vec": pa.array([held[j] for j in vec], pa.binary())})
    return run


def _block(docs: DataFrame, items: Items, k: int) -> DataFrame | None:
    """(item_id, doc_id, score, rank) of one block of items."""
    spark = docs.sparkSession
    if not len(items.terms):
        return None
    shared = spark.sparkContext.broadcast(items)
    rows = materialize(docs.mapInArrow(_vectors(shared), "doc_id long, n long, vec binary"), "vectors")
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_terms:
        return None
    rows = rows.filter("octet_length(vec) > 0")
    weight = np.zeros(len(items.terms), np.int64)
    for r in rows.select("vec").mapInArrow(_holders(len(items.terms)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    keyed = rows.withColumn("m", F.expr(f"10 + (cast(90 * n as decimal(20, 0)) * cast({n_docs} as decimal(18, 0))) div cast({n_terms} as decimal(20, 0))")) \
        .withColumn("h", F.xxhash64("vec", "m"))
    # one row per class; equal hashes are verified by the vectors themselves
    classes = keyed.groupBy("h", "m", "vec").agg(F.min("doc_id").alias("first")).select("first", "m", "vec")
    shape = "item int, score long, first long, m long, vec binary"
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"), "m", "vec")
    top = (classes.mapInArrow(_best(shared, spark.sparkContext.broadcast(weight), k), shape)
           .withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= k))
    top = materialize(top.withColumn("h", F.xxhash64("vec", "m")).drop("place", "first"), "classes")
    by_id = Window.partitionBy("h", "m", "vec").orderBy(F.asc_nulls_last("doc_id"))
    members = (sieved(keyed, "h", sieve(top, "h")).filter("may_have").select("h", "m", "vec", "doc_id")
               .withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k).drop("place"))
    by_rank = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = (members.join(top, ["h", "m", "vec"]).withColumn("rank", F.row_number().over(by_rank))
              .filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score"))
    names = spark.createDataFrame([(i, x) for i, x in enumerate(items.ids)], "item int, item_id long")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def ranked_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                     item_text: str = "text", k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """Per item its ``k`` documents of the highest scores above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / item_bytes))
    out = []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()
        out.append(_block(docs, Items([r["item_id"] for r in rows], [r["text"] for r in rows]), k))
    out = [x for x in out if x is not None]
    return functools.reduce(DataFrame.union, out) if out else \
        spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


#: DuckDB SQL of the query's rows, straight from the definition.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT row_id, doc_id, n, term, count(*) AS tf FROM (SELECT row_id, doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
g AS (SELECT q.item_id, tf.row_id, tf.doc_id,
        sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * tf.n * s.n_docs) // s.n_terms))))::BIGINT AS score
      FROM tf JOIN w USING (term) JOIN q USING (term), s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM g WHERE score > 0 QUALIFY rank <= 10
"""
