"""Key exchange between chunks of documents: which of a chunk's hashed keys occur where, without shipping positions.

Tasks pack consecutive documents into chunks of a few megabytes. A chunk sends the sorted distinct 64-bit keys of its
texts to buckets by key range, packed into one binary value per bucket; a bucket answers with bits or numbers in the
order of those keys. So a key costs a few bytes however often it occurs in a chunk, and no bucket grows with a hot key.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tarnquery.llm.hashing import U, slices, string_parts, trim
from tarnquery.llm.session import parts_for, text_bytes

#: Bytes of text in a chunk and in one of its rows; hashed keys in a bucket, on average; bytes of text in a partition.
CHUNK_BYTES, PIECE_BYTES, BUCKET_KEYS, WORD_BYTES, PART_BYTES = 4 << 20, 512 << 10, 2_000_000, 6, 64 << 20
CHUNK = "chunk"


def _pack_rows(batches, text: int, most: int, piece: int):
    """Rows as pieces (chunk, compressed Arrow stream) of chunks of about `most` bytes of text, in the order they come."""
    chunk, size, held, waiting = TaskContext.get().partitionId() << 32, 0, [], 0

    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))

    def emit():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
            for x in held:
                out.write_batch(x)
        row = [pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(row, [CHUNK, "data"])

    for batch in batches:
        offs = string_parts(batch.column(text))[1]
        for a, b in slices(offs, piece):
            more = int(offs[b] - offs[a])
            if held and (waiting + more > piece or size + more > most):
                yield emit()
                held, waiting = [], 0
            if size and size + more > most:
                chunk, size = chunk + 1, 0
            held.append(batch.slice(a, b - a))
            size, waiting = size + more, waiting + more
    if held:
        yield emit()
    trim()


def chunked(docs: DataFrame, text_col: str) -> tuple[DataFrame, int]:
    """docs as chunks (chunk, data), dealt out by chunk; and the number of buckets for one key a word.

    Chunks are cut by position, so neither equal rows nor null ids pile up in one. A partition holds many chunks.
    """
    size = text_bytes(docs, text_col)
    packed = docs.mapInArrow(
        partial(_pack_rows, text=docs.columns.index(text_col), most=CHUNK_BYTES, piece=min(PIECE_BYTES, CHUNK_BYTES)),
        f"{CHUNK} long, data binary",
    )
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, parts_for(size, PART_BYTES))
    return packed.repartition(parts, CHUNK), parts_for(size, WORD_BYTES * BUCKET_KEYS)


def rows_of(pieces: pa.Table) -> pa.Table:
    """The documents of a chunk, from its pieces."""
    tables = [pa.ipc.open_stream(x.as_buffer()).read_all() for column in pieces["data"].chunks for x in column]
    return pa.concat_tables(tables).combine_chunks()


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range starts in the sorted keys, and the end."""
    firsts = np.array([-((-b << 64) // buckets) for b in range(1, buckets)], U)
    return np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]]).astype(np.int64)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of as many bytes as the largest takes."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=U(0))
    first, steps = int(steps[0]), steps.copy()
    steps[0] = 0
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    small = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width])
    return bytes([width]) + first.to_bytes(8, "little") + small.tobytes()


def unpack(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    width = data[0]
    small = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    steps = np.zeros((len(small), 8), np.uint8)
    steps[:, :width] = small
    steps = steps.view(U).reshape(-1)
    steps[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(steps, dtype=U)


def pack_bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unpack_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def pack_counts(values: np.ndarray) -> bytes:
    """Mostly small numbers in a byte each; those of 255 or more follow in full."""
    large = values >= 255
    full, small = values[large].astype(np.int64), np.where(large, 255, values).astype(np.uint8)
    return len(full).to_bytes(8, "little") + full.tobytes() + small.tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(data, np.uint8, offset=8 + 8 * n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, np.int64, n, offset=8)
    return out
