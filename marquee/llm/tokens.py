"""Token ids as compressed binary files: written in key order, read back and checked."""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm import rangecoder
from marquee.llm.arrays import tidy
from marquee.llm.warc import files
from marquee.llm.word_ids import WordEncoder, spans
from marquee.session import durable, new_folder

#: A file: MAGIC, groups of blocks, the document index, a footer that says where the index is.
MAGIC = b"MQIDS02\n"
GROUP = "<IIII"  # blocks, bits an id needs, bytes of the odds that follow, their crc32; zeros end the groups
BLOCK = "<III"  # ids, crc32 of the ids, bytes of payload
FOOTER = "<QQQI"  # offset of the index, documents, ids, crc32 of the index
#: Blocks that are coded in step, and held in memory at once.
GROUP_BLOCKS = 2048
#: Bytes of text that are encoded at once: more makes fewer words anew, and takes more memory.
PART = 6_000_000


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker, so that a task need not learn the common words anew."""
    return WordEncoder(path)


class Writer:
    """One file of documents in key order."""

    def __init__(self, stream, block_group: int = GROUP_BLOCKS):
        self.stream, self.room = stream, block_group * rangecoder.BLOCK
        self.held: list[np.ndarray] = []
        self.waiting = self.offset = self.ids = 0
        self.keys: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.offset += len(data)

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys.astype("<i8"))
        self.sizes.append(sizes.astype("<u8"))
        self.held.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= self.room:
            everything, self.held = np.concatenate(self.held), []
            whole = len(everything) // self.room * self.room
            for at in range(0, whole, self.room):
                self._group(everything[at : at + self.room])
            self.held, self.waiting = [everything[whole:].copy()], len(everything) - whole

    def _group(self, ids: np.ndarray) -> None:
        bits = rangecoder.id_bits(ids)
        odds, blocks = rangecoder.encode_fitted(ids, bits)
        shared = odds.pack()
        self._write(struct.pack(GROUP, len(blocks), bits, len(shared), zlib.crc32(shared)) + shared)
        self._write(b"".join(struct.pack(BLOCK, n, crc, len(payload)) for n, crc, payload in blocks))
        for *_, payload in blocks:
            self._write(payload)

    def close(self) -> None:
        if self.waiting:
            self._group(np.concatenate(self.held))
        self._write(struct.pack(GROUP, 0, 0, 0, 0))
        at = self.offset
        sizes = np.concatenate(self.sizes) if self.sizes else np.zeros(0, dtype="<u8")
        index = b"".join(k.tobytes() for k in self.keys) + sizes.tobytes()
        self._write(index)
        self._write(struct.pack(FOOTER, at, len(sizes), self.ids, zlib.crc32(index)))
        self.stream.close()


def read_file(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a file: keys and sizes of all documents first, then the ids of each group.

    Every checksum is verified.
    """
    stream.seek(stream.size() - struct.calcsize(FOOTER))
    at, documents, ids, crc = struct.unpack(FOOTER, stream.read(struct.calcsize(FOOTER)))
    stream.seek(at)
    index = stream.read(16 * documents)
    if zlib.crc32(index) != crc:
        raise rangecoder.CorruptBlock("the document index does not match its checksum")
    none = np.zeros(0, dtype="<u4")
    yield np.frombuffer(index[: 8 * documents], dtype="<i8"), np.frombuffer(index[8 * documents :], dtype="<u8"), none
    stream.seek(0)
    if stream.read(len(MAGIC)) != MAGIC:
        raise rangecoder.CorruptBlock("no file of token ids")
    seen = 0
    while True:
        count, bits, size, crc = struct.unpack(GROUP, stream.read(struct.calcsize(GROUP)))
        if not count:
            break
        shared = stream.read(size)
        if zlib.crc32(shared) != crc:
            raise rangecoder.CorruptBlock("the odds of a group do not match their checksum")
        odds = rangecoder.Odds.unpack(shared)
        heads = [struct.unpack(BLOCK, stream.read(struct.calcsize(BLOCK))) for _ in range(count)]
        part = rangecoder.decode([(n, check, stream.read(size)) for n, check, size in heads], bits, odds)
        seen += len(part)
        yield none, none, part
    if seen != ids:
        raise rangecoder.CorruptBlock(f"the file holds {seen} ids of {ids}")


def write_tokens(
    docs: DataFrame, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text", folder: str | None = None
) -> DataFrame:
    """Encode whole texts and write files in key order: folder, path, part, start, ids, documents, bytes.

    ``tokenizer`` is the path of a tokenizer file, reachable from the executors; see
    :func:`word_encoder`.  ``end_id`` follows each document.  A null text is empty;
    rows without a key stand first, under the key -2^63; repeated rows are written each, those of
    one key in the order of their texts.  Files are ranges of keys; ``start`` counts the ids in
    the files before.  Names are new for each attempt of a task and only those of successful
    ones are returned, so repeated tasks leave nothing twice.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # Nulls come first in an ascending order.
    placed = rows.repartitionByRange("_key").sortWithinPartitions("_key", "_text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = word_encoder(tokenizer)
        system, root = files(folder)
        system.create_dir(root, recursive=True)
        out, documents, first = None, 0, None
        path = f"{root}/{uuid.uuid4().hex}.ids"
        for batch in batches:
            keys, texts = pc.fill_null(batch.column(0), -(1 << 63)).to_numpy(zero_copy_only=False), batch.column(1)
            for a, b in spans(texts, PART):
                ids, sizes = encoder.encode(texts.slice(a, b - a))
                ids = np.insert(ids, np.cumsum(sizes), end_id)
                if out is None:
                    out = Writer(system.open_output_stream(path, compression=None))
                    first = int(keys[0])
                out.add(keys[a:b], sizes + 1, ids)
                documents += len(sizes)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"path": [path], "_first": [first], "ids": [out.ids], "documents": [documents], "bytes": [out.offset]}
            )

    # Rows of one key share a partition, so the first keys of the files order them.
    written = durable(placed.mapInArrow(tidy(write), "path string, _first long, ids long, documents long, bytes long"))
    before = Window.orderBy("_first")  # one row per file
    return durable(
        written.select(
            F.lit(folder).alias("folder"),
            "path",
            F.row_number().over(before).alias("part"),
            F.coalesce(F.sum("ids").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
            "ids",
            "documents",
            "bytes",
        )
    )


def read_tokens(written: DataFrame, with_ids: bool = True, key: str = "doc_id") -> DataFrame:
    """Documents read back from files: key, start, n_tokens, ids_crc32 and, if wanted, ids.

    ``start`` counts the ids of all documents before, ``ids_crc32`` is that of the ids as
    32-bit little endian.  A damaged file fails.  Rows without a key come back so.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder, path, start in zip(batch["folder"], batch["path"], batch["start"], strict=True):
                system, _ = files(folder)
                with system.open_input_file(path) as stream:
                    parts = read_file(stream)
                    keys, sizes, held = next(parts)
                    sizes = sizes.astype(np.int64)
                    ends = np.cumsum(sizes)
                    at, base = 0, 0
                    pieces: list[np.ndarray] = [held]
                    for *_, ids in parts:
                        held = np.concatenate((*pieces, ids))
                        pieces = [held]
                        upto = int(np.searchsorted(ends, base + len(held), side="right"))
                        if upto == at:
                            continue
                        cut = [*(ends[at:upto] - sizes[at:upto] - base), ends[upto - 1] - base]
                        spans = [held[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                        frame = pd.DataFrame(
                            {
                                "_key": pd.array(keys[at:upto], dtype="Int64"),
                                "start": ends[at:upto] - sizes[at:upto] + start,
                                "n_tokens": sizes[at:upto],
                                "ids_crc32": [zlib.crc32(s.tobytes()) for s in spans],
                            }
                        )
                        frame.loc[frame["_key"] == -(1 << 63), "_key"] = pd.NA
                        if with_ids:
                            frame["ids"] = [s.astype(np.int64) for s in spans]
                        yield frame
                        pieces, base, at = [held[cut[-1] :].copy()], int(ends[upto - 1]), upto

    schema = "_key long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    count = max(1, written.count())
    rows = written.select("folder", "path", "start").repartition(count)
    return rows.mapInPandas(tidy(read), schema).withColumnRenamed("_key", key)
