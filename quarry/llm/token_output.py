"""Token ids as fixed-width bit-packed shard files.

A file holds the ids of consecutive documents, each id in the fewest bits that hold the vocabulary.
Ids lie in blocks of ``block_ids`` that start at whole bytes; with the table of block offsets and the
documents' ends any range of ids is unpacked by numpy without reading the rest.

    magic "QTOKENS1" | bits, block_ids, documents, ids, blocks as little-endian uint64
    | block offsets (blocks + 1) uint64 | document ends uint64 | document ids int64
    | 1 where the document id is null, uint8 | packed blocks

Documents are dealt to range shards of their id, sorted inside each, encoded there and written in
files of a bounded number of ids; only documents' counts travel on.

Defined cases: a null or empty text has the end id alone; a null doc_id comes before all others;
rows with one doc_id follow each other by text length, then text; an empty table writes no file;
extra columns are ignored."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import units as U
from quarry.llm import words as W
from quarry.llm.shards import commit_file, range_bounds, shard_of
from quarry.llm.store import bounded_batches, materialize, scratch

MAGIC = b"QTOKENS1"
END_ID = 2
BLOCK_IDS = 4096
#: Ids in a file (it ends at the document that reaches this), and text bytes dealt to a shard.
FILE_IDS = 4 << 20
SHARD_BYTES = 48 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    planes = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def file_chunks(ids: np.ndarray, ends: np.ndarray, docs: np.ndarray, nulls: np.ndarray, bits: int, block_ids: int = BLOCK_IDS):
    """The bytes of one file, block by block."""
    blocks = -(-len(ids) // block_ids)
    size = [(min(block_ids, len(ids) - b * block_ids) * bits + 7) // 8 for b in range(blocks)]
    yield MAGIC + struct.pack("<5Q", bits, block_ids, len(ends), len(ids), blocks)
    yield np.concatenate([[0], np.cumsum(size)]).astype("<u8").tobytes()
    yield ends.astype("<u8").tobytes() + docs.astype("<i8").tobytes() + nulls.astype(np.uint8).tobytes()
    for b in range(blocks):
        yield pack(ids[b * block_ids:(b + 1) * block_ids], bits)


class TokenFile:
    """Reader of one file's bytes (a memory map or a buffer)."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block_ids, n, self.n_ids, blocks = struct.unpack("<5Q", data[8:48])
        at = 48
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        at += 8 * (blocks + 1)
        self.ends = np.frombuffer(data, "<u8", n, at).astype(np.int64)
        self.docs = np.frombuffer(data, "<i8", n, at + 8 * n)
        self.nulls = np.frombuffer(data, np.uint8, n, at + 16 * n).astype(bool)
        self.data, self.base = data, at + 17 * n

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi - 1; only the blocks that hold them are read."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block_ids, (hi - 1) // self.block_ids
        got = []
        for b in range(first, last + 1):
            n = min(self.block_ids, self.n_ids - b * self.block_ids)
            got.append(unpack(self.data[self.base + int(self.offsets[b]):self.base + int(self.offsets[b + 1])], self.bits, n))
        return np.concatenate(got)[lo - first * self.block_ids:hi - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def _writer(path: str, folder: str, end_id: int, file_ids: int):
    def run(batches):
        codes = U.unit_codes(path)
        bits = bits_for(max(codes.size, end_id + 1))
        shard, seq, ids, many, docs, nulls, held = None, 0, [], [], [], [], 0

        def flush():
            nonlocal seq, held
            ends = np.cumsum(np.concatenate(many))
            chunks = file_chunks(np.concatenate(ids), ends, np.concatenate(docs), np.concatenate(nulls), bits)
            commit_file(folder, f"tokens-{shard:05d}-{seq:05d}.bin", chunks)
            row = (shard, seq, int(ends[-1]), len(ends))
            seq, held = seq + 1, 0
            for x in (ids, many, docs, nulls):
                x.clear()
            return pa.RecordBatch.from_pydict(dict(zip(("shard", "seq", "n_ids", "n_docs"), [pa.array([row[0]], pa.int32()), pa.array([row[1]], pa.int32()), pa.array([row[2]]), pa.array([row[3]])])))

        for batch in batches:
            own = np.asarray(batch.column("shard"))
            key = batch.column("doc_id")
            no_id = np.asarray(key.is_null())
            key = np.asarray(key.fill_null(0))
            for lo, hi, raw, offs in W.blocks(batch.column("text"), U.BLOCK_BYTES):
                got, n = codes.encode(*U.units(raw, offs))
                cut = np.concatenate([[0], np.cumsum(n)])
                full = np.insert(got, cut[1:], end_id)
                edge = cut + np.arange(len(cut))  # each document has its end id too
                r = 0
                while r < hi - lo:
                    if shard != own[lo + r]:
                        if held:
                            yield flush()
                        shard, seq = int(own[lo + r]), 0
                    stop = r + int(np.searchsorted(own[lo + r:hi], shard, side="right"))
                    stop = min(stop, max(r + 1, int(np.searchsorted(edge, edge[r] + file_ids - held, side="left"))))
                    ids.append(full[edge[r]:edge[stop]].astype(np.uint16 if bits <= 16 else np.uint32))
                    many.append(n[r:stop] + 1)
                    docs.append(key[lo + r:lo + stop])
                    nulls.append(no_id[lo + r:lo + stop])
                    held += int(edge[stop] - edge[r])
                    r = stop
                    if held >= file_ids:
                        yield flush()
        if held:
            yield flush()
    return run


def _reader(batches):
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            f = TokenFile(content.as_buffer())
            shard, seq = map(int, path.rsplit("/", 1)[-1][len("tokens-"):-len(".bin")].split("-"))
            n, first = len(f.ends), np.concatenate([[0], f.ends[:-1]]).astype(np.int64)
            crc = np.zeros(n, np.int64)
            for lo in range(0, n, 256):  # documents at a time, from the blocks that hold them
                hi = min(n, lo + 256)
                part = memoryview(f.ids(int(first[lo]), int(f.ends[hi - 1])).astype("<u4").tobytes())
                for i in range(lo, hi):
                    crc[i] = zlib.crc32(part[4 * int(first[i] - first[lo]):4 * int(f.ends[i] - first[lo])])
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.full(n, shard, np.int32)), "seq": pa.array(np.full(n, seq, np.int32)),
                "doc_id": pa.array(f.docs, mask=f.nulls), "own_start": pa.array(first),
                "n_tokens": pa.array(f.ends - first), "ids_crc32": pa.array(crc)})


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = U.DEFAULT_TOKENIZER, end_id: int = END_ID, file_ids: int = FILE_IDS,
                 shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents as token files into ``folder``; returns the manifest (shard, seq, n_ids, n_docs)."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bounds = range_bounds(slim.select("doc_id", F.octet_length("text").alias("w")), "doc_id", F.col("w") + 64, shard_bytes)
    dealt = (slim.withColumn("shard", shard_of("doc_id", bounds)).repartitionById(len(bounds) + 1, F.col("shard"))
             .withColumn("size", F.coalesce(F.octet_length("text"), F.lit(-1)))
             .sortWithinPartitions("shard", "doc_id", "size", "text").select("shard", "doc_id", "text"))
    manifest = materialize(dealt.mapInArrow(_writer(U.tokenizer_path(tokenizer), folder, end_id, file_ids),
                                            "shard int, seq int, n_ids long, n_docs long"), "token-manifest")
    return manifest


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    shape = "shard int, seq int, doc_id long, own_start long, n_tokens long, ids_crc32 long"
    totals = {r["shard"]: r["n"] for r in manifest.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # at most MOST_SHARDS
    if not totals:
        return spark.createDataFrame([], shape).select("doc_id", F.col("own_start").alias("start"), "n_tokens", "ids_crc32")
    base, acc = [], 0
    for s in sorted(totals):
        base.append((s, acc))
        acc += totals[s]
    files = manifest.join(F.broadcast(spark.createDataFrame(base, "shard int, base long")), "shard")
    before = F.sum("n_ids").over(_in_shard()) - F.col("n_ids")
    files = files.select("shard", "seq", (F.col("base") + before).alias("file_start"))
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder).select("path", "content")
    return (rows.mapInArrow(_reader, shape).join(files, ["shard", "seq"])
            .select("doc_id", (F.col("file_start") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32"))


def _in_shard():
    from pyspark.sql import Window
    return Window.partitionBy("shard").orderBy("seq")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to new files in the shared folder and return what they hold."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, **options), folder)
