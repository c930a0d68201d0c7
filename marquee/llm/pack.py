"""Packing by concatenate and cut: all documents as one stream of ids, cut into windows of a fixed size.

Two passes.  The first encodes each partition and writes its documents with the number of ids
before them in the partition.  Prefix sums over the totals of the partitions, one number each, then
say where every document begins in the stream.  The second pass cuts: a window that lies in one
task is complete there, and only the first and last window of a task, its boundary records, are
shuffled to be joined.  No document is ever grouped, sorted or moved by key.

Nulls: a null text is empty, so the document is its end id alone; a null key is kept as it is.
Repeated rows are packed each.  An empty table gives empty results.  Other columns of the input are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.word_ids import WordEncoder, spans
from marquee.session import durable

ROOM = 4096


def tokenized(docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """First pass: ``_part, _before, _key, _size, _ids`` of each document, written to the shared folder.

    ``_ids`` are the ids and ``end_id`` as little-endian unsigned 32-bit integers, ``_size`` counts
    them, and ``_before`` counts those of the documents before it in its partition.  ``tokenizer``
    is the path of a tokenizer file that executors can reach.  A repeated task gives the same rows
    from the same split, and Spark keeps those of one attempt only.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, before, encoder = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            encoder = encoder or WordEncoder(tokenizer)
            keys, texts = batch.column(0), batch.column(1)
            for a, b in spans(texts):
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
                sizes = sizes + 1
                ends = np.cumsum(sizes)
                cuts = np.concatenate(([0], ends * 4)).astype(np.int32)
                packed = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, part)), pa.array(before + ends - sizes), keys.slice(a, b - a), pa.array(sizes), packed],
                    ["_part", "_before", "_key", "_size", "_ids"],
                )
                before += int(ends[-1])

    return durable(rows.mapInArrow(encode, f"_part long, _before long, _key {kind}, _size long, _ids binary"))


def placed(tokens: DataFrame) -> DataFrame:
    """The documents of the first pass with ``_start``, the number of ids before each in the stream.

    The totals, one row per partition of the first pass, meet in one task and are broadcast: their
    number is that of the input splits, not of the documents.
    """
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = tokens.groupBy("_part").agg(F.sum("_size").alias("_total"))
    starts = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    joined = tokens.join(F.broadcast(starts), "_part")
    return joined.select("_key", "_size", "_ids", (F.col("_base") + F.col("_before")).alias("_start"))


def pieces(stream: DataFrame, room: int = ROOM, key: str = "doc_id") -> DataFrame:
    """Where each document of ``placed`` went: a row per document and window that it reaches into.

    ``key, start, length, ids_crc32, doc_tokens, sequence_id, offset``: ``start`` counts the ids of
    the document before the piece, ``offset`` those of the sequence, ``ids_crc32`` is unsigned, of
    the piece's ids as little-endian unsigned 32-bit integers.
    """
    at, size = F.col("_start"), F.col("_size")

    def piece(window: Column) -> Column:
        begin = F.greatest(window * room - at, F.lit(0).cast("long"))
        length = F.least((window + 1) * room - at, size) - begin
        ids = F.substring(F.col("_ids"), (begin * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(
            begin.alias("start"),
            length.alias("length"),
            F.crc32(ids).alias("ids_crc32"),
            size.alias("doc_tokens"),
            window.alias("sequence_id"),
            (at + begin - window * room).alias("offset"),
        )

    first, last = F.expr(f"_start div {room}L"), F.expr(f"(_start + _size - 1) div {room}L")
    cut = stream.select(F.col("_key").alias(key), F.transform(F.sequence(first, last), piece).alias("_pieces"))
    return cut.select(key, F.inline("_pieces"))


def sequences(stream: DataFrame, room: int = ROOM) -> DataFrame:
    """The windows themselves: ``sequence_id, ids, n_tokens, padded``.

    ``ids`` are little-endian unsigned 32-bit integers.  All sequences are full but the last, which
    is to be padded to ``padded`` ids: ``room``, or its own length where that is a power of two.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = b"", None  # ids not yet given out, and where in the stream they begin

        def emit(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            numbers, offsets, ids = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64()), pa.array(ids, pa.binary())],
                ["sequence_id", "_offset", "_ids"],
            )

        for batch in batches:
            out = []
            for start, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if at is None or start != at + len(held) // 4:  # another split begins
                    if held:
                        out.append((at // room, at % room, held))
                    held, at = b"", start
                held += ids
                done = 0
                while len(held) - done >= 4 * (room - at % room):
                    size = 4 * (room - at % room)
                    out.append((at // room, at % room, held[done : done + size]))
                    done, at = done + size, at + size // 4
                held = held[done:]
            yield emit(out)
        if held:
            yield emit([(at // room, at % room, held)])

    windows = stream.select("_start", "_ids").mapInArrow(cut, "sequence_id long, _offset long, _ids binary")
    windows = durable(windows)  # read twice below
    whole = F.length("_ids") == 4 * room
    # At most ``room`` ids share a sequence_id.
    boundary = windows.where(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("_offset", "_ids"))).alias("_all"))
    joined = F.aggregate("_all", F.lit(b""), lambda ids, piece: F.concat(ids, piece["_ids"]))
    every = windows.where(whole).select("sequence_id", F.col("_ids").alias("ids")).unionByName(
        boundary.select("sequence_id", joined.alias("ids"))
    )
    size = (F.length("ids") / 4).cast("long")
    power = size.bitwiseAND(size - 1) == 0
    return every.select("sequence_id", "ids", size.alias("n_tokens"), F.when(power, size).otherwise(F.lit(room)).alias("padded"))


def pack(docs: DataFrame, tokenizer: str, room: int = ROOM, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and pack whole documents; the pieces, as :func:`pieces` gives them."""
    return pieces(placed(tokenized(docs, tokenizer, end_id, key, text)), room, key)
