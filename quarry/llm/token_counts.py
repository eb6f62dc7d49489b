"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone by the library; those that give back exactly
their own id are proven whole tokens. Per document the pre-tokens that are whole tokens count one
each, straight from their identifiers; only the rest is merged by the library, each distinct one
once. The proof is a table of the vocabulary's size, so it is small whatever the corpus.

Defined cases: a null or empty text has 0 bytes and 0 tokens; rows are independent, so repeated
ids, ties and null ids stay as they are; extra columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import units as U
from quarry.llm import words as W
from quarry.llm.store import bounded_batches


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in order,
    for the code points from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(path: str) -> np.ndarray:
    """Sorted identifiers of the vocabulary strings proven to encode alone as their one token."""
    t = U.load_tokenizer(path)
    letters = _byte_letters()
    vocab = [(bytes(letters[c] for c in s[:-4]), i) for s, i in t.get_vocab(with_added_tokens=False).items() if s.endswith("</w>")]
    codes = t.encode_batch_fast([s.decode("utf-8", "replace") for s, _ in vocab], add_special_tokens=False)
    proven = [s for (s, i), c in zip(vocab, codes) if s and c.ids == [i]]
    buf = np.frombuffer(b"".join(proven), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(p) for p in proven])]).astype(np.int64)
    return np.unique(W.span_ident(buf, offs[:-1], offs[1:]))


def _counts(proof, path: str, limit: int):
    def run(batches):
        whole, codes = proof.value, U.unit_codes(path)
        for batch in batches:
            for lo, hi, raw, offs in W.blocks(batch.column(1), U.BLOCK_BYTES):
                buf, w, plain = U.units(raw, offs)
                distinct, at, back = np.unique(w.ident, return_index=True, return_inverse=True)
                near = np.minimum(np.searchsorted(whole, distinct), len(whole) - 1)
                count = (whole[near] == distinct).astype(np.int64)
                rest = at[count == 0]
                part = W.Words(w.start[rest], w.end[rest], w.ident[rest], w.bound)
                place = codes.places(buf, part, plain[rest])  # may replace codes.many by a larger table
                count[count == 0] = codes.many[place]
                total = np.concatenate([[0], np.cumsum(count[back])])
                n = total[w.bound[1:]] - total[w.bound[:-1]]
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(lo, hi - lo), "n_bytes": pa.array(np.diff(offs)),
                    "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})
    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = U.DEFAULT_TOKENIZER, limit: int = 2048) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and whether n_tokens exceeds ``limit``."""
    bounded_batches(docs.sparkSession)
    path = U.tokenizer_path(tokenizer)
    proof = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    kind = docs.schema[id_col].dataType.simpleString()
    return (docs.select(F.col(id_col), F.col(text_col))
            .mapInArrow(_counts(proof, path, limit), f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
            .withColumnRenamed("id", id_col))
