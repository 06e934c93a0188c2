"""Token id files in bit planes: fixed-size blocks of ids, transposed, each plane compressed.

A *chunk* is a stretch of whole documents in doc_id order. Its ids are cut into blocks of
``BLOCK`` ids. A block is transposed: plane k holds bit k of every id, eight ids a byte, and is
compressed with zstandard on its own (an all-zero plane becomes a few bytes). Payload of a chunk:

    "QBP1", u32 number of blocks, then per block: u32 ids, u8 planes, u32 x planes sizes, the planes

The chunk index is stored beside the payload: documents of the chunk and their lengths, ids, and
the partition and place of the chunk; with the partition totals it gives every document's global
start. Chunks are written through Spark's file writer, so that a repeated task leaves no parts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.bpe import byte_vocabulary, slices
from quillflow.llm.common import row_slices
from quillflow.llm.token_runs import in_order, part_offsets

BLOCK = 1 << 15
CHUNK_IDS = 1 << 18
END_ID = 2
LEVEL = 3
MAGIC = b"QBP1"
CHUNK_FIELDS = "part int, chunk long, before long, n long, doc_ids array<long>, lengths array<long>, payload binary"


def pack_block(ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> bytes:
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, top.bit_length()) if len(ids) else 0
    # Two bytes an id where they do, then a row of bits per id, turned into a row of bits per plane.
    octets = np.ascontiguousarray(ids, "<u2" if top < 1 << 16 else "<u4").view(np.uint8).reshape(len(ids), -1)
    bits = np.ascontiguousarray(np.unpackbits(octets, axis=1, count=planes, bitorder="little").T)
    packed = [compressor.compress(row.tobytes()) for row in np.packbits(bits, axis=1)]
    return struct.pack(f"<IB{planes}I", len(ids), planes, *map(len, packed)) + b"".join(packed)


def encode_chunk(ids: np.ndarray, block: int = BLOCK, level: int = LEVEL) -> bytes:
    """The payload of one chunk of unsigned 32-bit ids."""
    compressor = zstandard.ZstdCompressor(level=level)
    blocks = [pack_block(ids[i:i + block], compressor) for i in range(0, len(ids), block)]
    return MAGIC + struct.pack("<I", len(blocks)) + b"".join(blocks)


def decode_chunk(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a chunk of bit planes")
    (blocks,), at = struct.unpack_from("<I", payload, 4), 8
    decompressor, out = zstandard.ZstdDecompressor(), [np.empty(0, "<u4")]
    for _ in range(blocks):
        n, planes = struct.unpack_from("<IB", payload, at)
        sizes = struct.unpack_from(f"<{planes}I", payload, at + 5)
        at += 5 + 4 * planes
        rows = np.empty((planes, -(-n // 8)), np.uint8)
        for k, size in enumerate(sizes):
            rows[k] = np.frombuffer(decompressor.decompress(payload[at:at + size]), np.uint8)
            at += size
        octets = np.zeros((n, 2 if planes <= 16 else 4), np.uint8)
        turned = np.packbits(np.unpackbits(rows, axis=1, count=n), axis=0, bitorder="little")
        octets[:, :len(turned)] = turned.T
        out.append(octets.view("<u2" if planes <= 16 else "<u4").ravel())
    return np.concatenate(out).astype("<u4", copy=False)


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write chunks, in ascending doc_id order, to ``folder``.

    Null counts as the empty text; each document ends with ``end_id``. A null doc_id comes first,
    rows that repeat a doc_id lie side by side, other columns are ignored, and an empty table
    writes files without chunks. A task holds one chunk and one document.
    """
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("before", pa.int64()), ("n", pa.int64()),
                        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
                        ("payload", pa.binary())])
    end = end_id.to_bytes(2, "little")

    def run(batches) -> Iterator[pa.RecordBatch]:
        encoder, part = byte_vocabulary(path, forced=False), TaskContext.get().partitionId()
        names: list = []
        held: list[bytes] = []
        state = {"chunk": 0, "before": 0, "ids": 0}

        def chunk() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u2").astype("<u4")
            row = [part, state["chunk"], state["before"], len(ids), list(names), [len(i) // 2 for i in held],
                   encode_chunk(ids)]
            state.update(chunk=state["chunk"] + 1, before=state["before"] + len(ids), ids=0)
            names.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in (part for whole in batches for part in row_slices(whole)):
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for name, ids in zip(doc_ids[a:b], encoder.encode([t or "" for t in texts[a:b]])):
                    names.append(name)
                    held.append(ids + end)
                    state["ids"] += len(ids) // 2 + 1
                    if state["ids"] >= chunk_ids:
                        yield chunk()
        if held:
            yield chunk()

    chunks = in_order(docs).select("doc_id", "text").mapInArrow(run, CHUNK_FIELDS)
    chunks.write.option("compression", "none").parquet(folder)


def read_index(spark, folder: str) -> DataFrame:
    """The chunk index with the global start of each chunk; the payload isn't read."""
    chunks = spark.read.schema(CHUNK_FIELDS).parquet(folder).drop("payload")
    return chunks.join(F.broadcast(part_offsets(chunks.select("part", "n"))), "part").select(
        "part", "chunk", (F.col("offset") + F.col("before")).alias("start"), "n", "doc_ids", "lengths")


def read_ids(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document, decoded from the files in ``folder``.

    ``start`` counts the ids of all documents before; ids are little-endian unsigned 32-bit integers.
    """
    chunks = spark.read.schema(CHUNK_FIELDS).parquet(folder)
    # One row per partition on the broadcast side.
    offsets = part_offsets(spark.read.schema(CHUNK_FIELDS).parquet(folder).select("part", "n"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, doc_ids, lengths, payload in zip(*batch.columns):
                data, sizes = decode_chunk(payload.as_py()).tobytes(), np.array(lengths.as_py(), np.int64)
                ends = np.cumsum(sizes)
                parts = [data[4 * (b - n):4 * b] for n, b in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids.as_py(), pa.int64()), pa.array(first.as_py() + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(parts, pa.binary())], schema=schema)

    return chunks.join(F.broadcast(offsets), "part").select(
        (F.col("offset") + F.col("before")).alias("first"), "doc_ids", "lengths", "payload").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")
