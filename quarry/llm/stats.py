"""Statistics of texts, vectorised over blocks of documents, and the learning table that joins them
with labels. Rates of empty texts are 0."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import words as W
from quarry.llm.store import bounded_batches, materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATES = ["mean_word", "symbol_rate", "upper_rate", "bang_rate", "digit_rate", "bar_rate", "stop_rate", "dup_line_rate",
         "repeat_rate", "distinct_rate", "echo_rate", "short_rate", "line_rate", "foreign_rate"]
#: Inputs of the learned models.
INPUTS = ["n_words", *RATES]

_B = np.arange(256)
_HEAD = (_B & 0xC0) != 0x80  # first byte of a code point
_SYMBOL = np.isin(_B, [ord(c) for c in "#*$%&|<>"])
_UPPER = (_B >= 65) & (_B <= 90)
_ALPHA = _UPPER | ((_B >= 97) & (_B <= 122))
_DIGIT = (_B >= 48) & (_B <= 57)
_FOREIGN = _B >= 0xC0
_STOP = np.isin(_B, [ord(c) for c in ".,;:?"])
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _per_doc(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offs[1:]] - total[offs[:-1]]


def _by_doc(doc: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(doc, minlength=rows).astype(np.int64)


def _keyed(ident: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return W.mix(ident + doc.astype(np.uint64) * np.uint64(W._BASE))


def text_stats(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS (whole numbers) and RATES of each document of a block."""
    rows = len(offs) - 1
    w = W.words(buf, offs, W.SPACED)
    doc = w.doc
    n = np.diff(w.bound)
    head = np.concatenate([[0], np.cumsum(_HEAD[buf])])
    size = head[w.end] - head[w.start]  # code points of each word
    word_chars = np.bincount(doc, weights=size, minlength=rows).astype(np.int64)

    start, end = W.spans(buf, offs, _LINE)  # lines that are not empty
    has = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)  # with a word
    start, end = start[has], end[has]
    line_doc = np.searchsorted(offs, start, side="right") - 1
    lines = _by_doc(line_doc, rows)
    _, first = np.unique(_keyed(W.span_ident(buf, start, end), line_doc), return_index=True)
    dup_lines = lines - _by_doc(line_doc[first], rows)

    at, tri = W.grams(w, 3)
    _, back, many = np.unique(_keyed(tri, doc[at]), return_inverse=True, return_counts=True)
    again = at[many[back] > 1] if len(at) else at
    cover = np.zeros(len(w.ident) + 3, bool)
    for j in range(3):
        cover[again + j] = True
    repeat = _by_doc(doc[cover[:len(doc)]], rows)

    _, first = np.unique(_keyed(w.ident, doc), return_index=True)
    distinct = _by_doc(doc[first], rows)
    echo = np.zeros(len(doc), bool)
    echo[1:] = (w.ident[1:] == w.ident[:-1]) & (doc[1:] == doc[:-1])
    out = {"n_words": n, "word_chars": word_chars, "n_symbols": _per_doc(_SYMBOL[buf], offs), "n_dup_lines": dup_lines, "n_repeat_words": repeat}
    rate = lambda x, y: np.where(y > 0, x / np.maximum(y, 1), 0.0)
    chars = _per_doc(_HEAD[buf], offs)
    out |= {"mean_word": rate(word_chars, n), "symbol_rate": rate(out["n_symbols"], n),
            "upper_rate": rate(_per_doc(_UPPER[buf], offs), _per_doc(_ALPHA[buf], offs)),
            "bang_rate": rate(_per_doc(buf == ord("!"), offs), n), "digit_rate": rate(_per_doc(_DIGIT[buf], offs), chars),
            "bar_rate": rate(_per_doc(buf == ord("|"), offs), n), "stop_rate": rate(_per_doc(_STOP[buf], offs), n),
            "dup_line_rate": rate(dup_lines, lines), "repeat_rate": rate(repeat, n), "distinct_rate": rate(distinct, n),
            "echo_rate": rate(_by_doc(doc[echo], rows), n), "short_rate": rate(_by_doc(doc[size <= 3], rows), n),
            "line_rate": rate(lines, n), "foreign_rate": rate(_per_doc(_FOREIGN[buf], offs), chars)}
    return out


def _add(batches):
    for batch in batches:
        for lo, hi, buf, offs in W.blocks(batch.column("text")):
            part, s = batch.slice(lo, hi - lo), text_stats(buf, offs)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *[pa.array(s[c].astype(np.int64)) for c in COUNTS], *[pa.array(s[c].astype(float)) for c in RATES]],
                names=[*part.schema.names, *COUNTS, *RATES])


def with_stats(docs: DataFrame, keep: list[str], text_col: str = "text", with_text: bool = False) -> tuple[DataFrame, list[str]]:
    """The rows with their statistics and the columns ``keep`` under working names, which are returned."""
    bounded_batches(docs.sparkSession)
    names = [f"k{i}" if c != text_col else "text" for i, c in enumerate(keep)]
    df = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names) if n != "text"], F.col(text_col).alias("text"))
    shape = T.StructType([*df.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS],
                          *[T.StructField(c, T.DoubleType()) for c in RATES]])
    df = df.mapInArrow(_add, shape)
    return (df if with_text else df.drop("text")), names


_HASHES = 1 << 40


def learning_sample(stats: DataFrame, labels: DataFrame, label: str, id_col: str, label_id: str = "doc_id", most: int = 20_000):
    """(inputs, labels, ids' crc32) of at most ``most`` labelled rows of ``stats``, those least by a hash
    of the id, on the driver. A document with several labels has their majority; nulls are no labels; of several texts of
    an id the one with the least statistics counts."""
    one = (labels.select(F.col(label_id).alias("label_id"), F.col(label).cast("double").alias("y")).filter("y is not null")
           .groupBy("label_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")))
    rows = (stats.join(one, F.col(id_col) == F.col("label_id")).withColumn("crc", F.crc32(F.col(id_col).cast("string")))
            .select(*INPUTS, "y", "crc", F.col(id_col).alias("id"), F.pmod(F.xxhash64(id_col), F.lit(_HASHES)).alias("h"))
            .groupBy("id").agg(F.min(F.struct(*INPUTS, "y", "crc", "h")).alias("least")).select("id", "least.*"))
    rows = materialize(rows, "labelled")
    n = rows.count()
    # all rows under this hash are about twice what is wanted, so tasks send the driver little more
    some = rows.filter(F.col("h") < int(_HASHES * 2 * most / n)) if n > 2 * most else rows
    rows = (rows if n > 2 * most and some.count() < most else some).orderBy("h", "id").limit(most).collect()
    x = np.array([[float(r[c]) for c in INPUTS] for r in rows]).reshape(len(rows), len(INPUTS))
    return x, np.array([r["y"] for r in rows], np.int64), np.array([r["crc"] for r in rows], np.int64)


def thresholds(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts of each input: midpoints at its quantiles, so that equal values stay together."""
    out = []
    for col in x.T:
        v = np.unique(col)
        if len(v) > bins:
            v = np.unique(np.quantile(col, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def condition(feature: int, above: bool, cut: float):
    """A threshold on an input as a Spark column."""
    c = F.col(INPUTS[feature])
    return c > F.lit(float(cut)) if above else c <= F.lit(float(cut))


def conjunction(rule):
    out = None
    for f, above, cut in rule:
        c = condition(f, above, cut)
        out = c if out is None else out & c
    return F.lit(True) if out is None else out


def holds(rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, cut in rule:
        ok &= (x[:, f] > cut) if above else (x[:, f] <= cut)
    return ok
