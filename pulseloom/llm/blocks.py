"""Compressed blocks of texts, and the exchange of distinct n-grams between blocks and corpus tables.

A block is one row: the carried columns of its texts, and the texts themselves in
compressed frames of a few MB, each text closed by END. A task unpacks one frame
at a time, so what it holds is bounded by a frame and by the block's distinct
n-grams, not by the number or the length of the texts. A block asks for each of
its distinct n-grams once, so that a frequent one has at most one row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StructField, StructType

from pulseloom.llm.common import small_batches, stage_by

BLOCK_BYTES, FRAME_BYTES, CHUNK = 48_000_000, 1_000_000, 500_000
END = b"\n"
FRAMES = ArrayType(StructType([StructField("train", BooleanType()), StructField("texts", LongType()), StructField("data", BinaryType())]))


def make_blocks(docs: DataFrame, carry: dict[str, Column], train: Column, normal: Callable[[bytes], bytes], block_bytes: int = BLOCK_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Blocks on the shared folder, bucketed by block, so that what is sent to a block meets it without moving it: block, frames and one array for each of `carry`, in the order of the texts in the frames.

    `train` marks the frames' texts (a frame holds marked texts or others only),
    `normal` turns a text's UTF-8 bytes (null: empty) into bytes without END.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    taken = docs.select(*[c.alias(n) for n, c in carry.items()], F.coalesce(train, F.lit(False)).alias("train_"), F.coalesce("text", F.lit("")).cast("binary").alias("text_"))
    width = len(carry)
    schema = StructType([StructField("block", LongType()), *[StructField(f.name, ArrayType(f.dataType)) for f in taken.schema.fields[:width]], StructField("frames", FRAMES)])
    arrow = to_arrow_schema(schema)

    def gather(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        squeeze, part, seq = zstandard.ZstdCompressor(level=6), TaskContext.get().partitionId(), 0
        pending: dict[bool, tuple[list, list]] = {False: ([], []), True: ([], [])}
        size = {False: 0, True: 0}
        frames: list[dict] = []
        told: list[list] = [[] for _ in range(width)]

        def close(flag):
            rows, texts = pending[flag]
            if texts:
                frames.append({"train": flag, "texts": len(texts), "data": squeeze.compress(END.join(texts) + END)})
                for column, values in zip(told, zip(*rows, strict=True), strict=True):
                    column.extend(values)
                pending[flag], size[flag] = ([], []), 0

        def flush():
            nonlocal frames, told, seq
            close(False)
            close(True)
            made = [[(part << 32) + seq], *([c] for c in told), [frames]]
            out = pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, arrow, strict=True)], schema=arrow)
            frames, told, seq = [], [[] for _ in range(width)], seq + 1
            return out

        held = 0
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *row, flag, text in zip(*columns, strict=True):
                body = normal(text)
                pending[flag][0].append(row)
                pending[flag][1].append(body)
                size[flag] += len(body) + 1
                held += len(body) + 1
                if size[flag] >= frame_bytes:
                    close(flag)
                if held >= block_bytes:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    return stage_by(taken.mapInArrow(gather, schema), "blocks", "block")


def unpacked(frames: list[dict]) -> Iterator[tuple[dict, bytes]]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    for f in frames:
        yield f, z.decompress(f["data"])


def merged_counts(parts, keys: str = "key"):
    """Arrow tables (key, n) -> one with each key once."""
    import pyarrow as pa

    return pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([keys, "n"])


def distinct_counts(found: Iterator[tuple], name: str, most: int = 1_000_000):
    """(Arrow array of keys, flag) pairs -> table (name, n): each key once, n its number under a true flag. Held: about `most` rows and the distinct keys."""
    import pyarrow as pa

    parts, held = [], 0
    for keys, flag in found:
        d = keys.dictionary_encode()
        n = np.bincount(d.indices.to_numpy(), minlength=len(d.dictionary)) if flag else np.zeros(len(d.dictionary))
        parts.append(pa.table({name: d.dictionary, "n": pa.array(n.astype(np.int64))}))
        held += len(d.dictionary)
        if held > most:
            parts = [merged_counts(parts, name)]
            held = 0
    return merged_counts(parts, name) if parts else None


def words_of(data: bytes):
    """Arrow array of the words of a frame (END as a word closes each text), and the number of words of each text."""
    import pyarrow as pa

    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(a == 10)
    cut = np.flatnonzero((a == 32) | (a == 10))
    starts = np.concatenate([[0], cut[:-1] + 1])
    length = cut - starts
    is_end = a[cut] == 10
    # A word per separator, and END after the last word of a text; the word before END is missing in an empty text.
    sizes = np.stack([length, is_end.astype(np.int64)], 1).ravel()
    there = np.stack([length > 0, is_end], 1).ravel()
    offsets = np.concatenate([[0], np.cumsum(sizes[there])]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(a[a != 32].tobytes())])
    per = np.bincount(np.searchsorted(ends, cut), (length > 0).astype(np.int64) + is_end, len(ends)).astype(np.int64)
    return words, per


def block_table(made: DataFrame, schema: str, each: Callable[[dict], object]) -> DataFrame:
    """(block, ...) rows of `each(row)`, an Arrow table by block."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                t = each(row)
                for b in t.to_batches(max_chunksize=50_000) if t is not None else []:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, row["block"])), *b.columns], names=["block", *b.schema.names])
                del t
                pa.default_memory_pool().release_unused()

    return made.mapInArrow(run, f"block long, {schema}")
