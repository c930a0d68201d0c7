"""Cross-entropy difference of documents under a target and a background bigram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from marquee.llm.arrays import hash_runs, mix64, owners, parts, runs
from marquee.session import durable

#: Bigrams with fewer occurrences in the background are left to the unigrams, in both models.
MIN_COUNT = 2
#: Weight of the unigram model beside the bigram model.
UNIGRAM = 0.4
#: Bytes of the texts whose words and pairs are counted in a shard.
SHARD = 8_000_000
#: Bytes of consecutive texts that are counted and scored together; a longer text stands alone.
BATCH = 4_000_000
WORD, PAIR = 0, 1


def words_of(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of a batch: first text, word hashes, and the text (from the first) of each word.

    Words are runs of characters other than ASCII white space, A-Z in lower case.
    """
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    for a, b in parts(texts):
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts[a:b]]
        codes = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        begins, ends = runs(~blank[codes])
        yield a, hash_runs(codes, begins, ends), owners(begins, bounds)


def _counted(values: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different values, how often each occurs, and how often where ``target`` holds."""
    found, at = np.unique(values, return_inverse=True)
    at = at.ravel()
    return found, np.bincount(at, minlength=len(found)), np.bincount(at[target], minlength=len(found))


def keys_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text of each word, whether it begins the text, its hash, and a hash of it and the one before."""
    found = [(owner + a, words) for a, words, owner in words_of(texts)]
    owner = np.concatenate([f[0] for f in found]) if found else np.zeros(0, dtype=np.int64)
    words = np.concatenate([f[1] for f in found]) if found else np.zeros(0, dtype=np.uint64)
    begins = np.diff(owner, prepend=-1) != 0
    before = np.where(begins, np.uint64(0), np.roll(words, 1))
    return owner, begins, words, mix64(before * np.uint64(0x9E3779B97F4A7C15) + words)


def _pack(values: np.ndarray) -> bytes:
    """Numbers, least significant bytes first of all, compressed."""
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel()


def _dealt(found: np.ndarray, n: np.ndarray, t: np.ndarray, shards: int) -> list[tuple]:
    """Shard, sorted keys (as differences) and counts of both corpora; shards are ranges of keys."""
    shard = ((found >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    return [
        (int(shard[a]), _pack(np.diff(found[a:b], prepend=np.uint64(0))), _pack(n[a:b]), _pack(t[a:b]))
        for a, b in zip(edges[:-1], edges[1:], strict=True)
    ]


COUNTS = "_batch long, _first long, _many int, _kind int, _shard long, _keys binary, _n binary, _t binary"
#: Counts sent back to a batch; a row of batch -1 has the sums of a shard instead.
ANSWERS = "_batch long, _first long, _many int, _kind int, _shard long, _n binary, _t binary, _words long, _total long, _totals long"


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with _batch: the first _row of the about BATCH bytes of text that a row belongs to."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size = -1, 0
        for batch in batches:
            ids = []
            sizes = pc.binary_length(batch.column("_text")).to_pylist()
            for row, n in zip(batch.column("_row").to_pylist(), sizes, strict=True):
                if first < 0 or size >= BATCH:
                    first, size = row, 0
                size += n + 1
                ids.append(first)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(ids, pa.int64())], names=[*batch.schema.names, "_batch"]
            )

    return rows.mapInArrow(number, StructType([*rows.schema.fields, StructField("_batch", LongType())]))


def counted(rows: DataFrame, shards: int) -> DataFrame:
    """For each batch the counts in both corpora of its words and pairs, and sums of each shard.

    Words and pairs are counted in the shard of their hash, and each shard answers those that
    named them, in the order of their different keys, so neither the driver nor a task holds the
    vocabulary.  An answer is for the _many rows of a batch from _first on.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            ids, numbers = frame["_batch"].to_numpy(), frame["_row"].to_numpy()
            new = (np.diff(ids, prepend=-1) != 0) | (np.diff(numbers, prepend=-9) != 1)
            edges = [*np.flatnonzero(new), len(ids)]
            for b, e in zip(edges[:-1], edges[1:], strict=True):
                target = frame["_target"].to_numpy(dtype=bool)[b:e]
                owner, _, *keys = keys_of(frame["_text"].iloc[b:e].tolist())
                if len(owner):
                    rows = [
                        (ids[b], numbers[b], e - b, kind, *row)
                        for kind in (WORD, PAIR)
                        for row in _dealt(*_counted(keys[kind], target[owner]), shards)
                    ]
                    yield pd.DataFrame(
                        rows, columns=["_batch", "_first", "_many", "_kind", "_shard", "_keys", "_n", "_t"]
                    )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        kind, shard = int(frame["_kind"].iloc[0]), int(frame["_shard"].iloc[0])
        named = [np.cumsum(_unpack(k), dtype=np.uint64) for k in frame["_keys"]]
        found, at = np.unique(np.concatenate(named), return_inverse=True)
        at = at.ravel()
        n, t = (
            np.bincount(at, weights=np.concatenate([_unpack(x) for x in frame[c]]), minlength=len(found)).astype(np.int64)
            for c in ("_n", "_t")
        )
        rows = [(-1, -1, 0, kind, shard, None, None, len(found), int(n.sum()), int(t.sum()))]
        if kind == PAIR:
            n, t = np.where(n >= MIN_COUNT, (n, t), 0)
        edge = 0
        for batch, first, many, keys in zip(frame["_batch"], frame["_first"], frame["_many"], named, strict=True):
            mine = at[edge : edge + len(keys)]
            edge += len(keys)
            rows.append((batch, first, many, kind, shard, _pack(n[mine]), _pack(t[mine]), 0, 0, 0))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWERS.split(", ")])

    return (
        rows.select("_batch", "_row", "_text", "_target")
        .mapInPandas(count, COUNTS)
        .groupBy("_kind", "_shard")
        .applyInPandas(add, ANSWERS)
    )


def bytes_of(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0


def score_lm(
    docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, n_tokens, target_loss, background_loss, score.

    Two interpolated bigram models, alike in vocabulary, count cutoff and smoothing, are counted
    over all texts: the target model over the documents whose key is in ``trusted``, the
    background model over all.  The score is the mean difference per word of the losses in bits,
    target minus background: the lower, the more a document resembles the target.

    Nothing is sampled and no word is left out: the vocabulary is every word of the corpus, and
    the counts of words and of word pairs stay in shards by 64-bit hash, which send each batch of
    texts the counts of what occurs in it.  A null or
    empty text has no words, zero losses and the score 0.  Without trusted documents the target
    model is uniform.  Repeated rows are scored each; rows without a key are background.
    Other columns are ignored; an empty table gives no rows.
    """
    ids = durable(trusted.select(F.col(key).alias("_trusted")).where("_trusted IS NOT NULL").distinct())
    body = F.coalesce(F.col(text), F.lit("")).alias("_text")
    flagged = docs.select(F.col(key).alias("_key"), body).join(
        ids, F.col("_key") == F.col("_trusted"), "left"
    )
    # One written copy of the texts serves all passes, so rows keep their numbers.
    rows = durable(
        numbered(
            flagged.select(
                "_key", "_text", F.col("_trusted").isNotNull().alias("_target"), F.monotonically_increasing_id().alias("_row")
            )
        )
    )
    answers = durable(counted(rows, bytes_of(rows) // SHARD + 1))
    sums = (
        answers.where(f"_batch = -1 AND _kind = {WORD}").agg(F.sum("_words"), F.sum("_total"), F.sum("_totals")).first()
    )
    size, total, total_t = (sums[0] or 0) + 1, sums[1] or 0, sums[2] or 0  # the words and an unseen one
    contexts = [rows.count(), rows.where("_target").count()]
    uniform = 1.0 / size

    def loss(n_pair: np.ndarray, n_context: np.ndarray, n_next: np.ndarray, n_all: int) -> np.ndarray:
        single = (n_next + 1.0) / (n_all + size)
        pair = np.where(n_context > 0, n_pair / np.maximum(n_context, 1), uniform)
        return -np.log2((1.0 - UNIGRAM) * pair + UNIGRAM * single)

    def score(batch: pa.Table, answered: pa.Table) -> pa.Table:
        batch = batch.sort_by("_row")
        numbers, texts = batch.column("_row").to_numpy(), batch.column("_text").to_pylist()
        answers_to: dict[int, dict] = {}
        for answer in answered.sort_by("_shard").to_pylist():
            of = answers_to.setdefault(answer["_first"], {"many": answer["_many"], WORD: [], PAIR: []})
            of[answer["_kind"]].append((_unpack(answer["_n"]), _unpack(answer["_t"])))
        counts = np.zeros(len(texts), dtype=np.int64)
        losses = np.zeros((2, len(texts)))
        for first, of in answers_to.items():
            start = int(np.searchsorted(numbers, first))
            owner, begins, *keys = keys_of(texts[start : start + of["many"]])
            owner = owner + start
            counts += np.bincount(owner, minlength=len(texts))
            (n, t), (n_pair, t_pair) = (
                [np.concatenate(part)[at.ravel()].astype(np.int64) for part in zip(*of[kind], strict=True)]
                for kind in (WORD, PAIR)
                for _, at in [np.unique(keys[kind], return_inverse=True)]
            )
            for k, (pair, single, starts, everything) in enumerate(
                ((t_pair, t, contexts[1], total_t), (n_pair, n, contexts[0], total))
            ):
                context = np.where(begins, starts, np.roll(single, 1))
                losses[k] += np.bincount(owner, weights=loss(pair, context, single, everything), minlength=len(texts))
        target, background = losses / np.maximum(counts, 1)
        return pa.table(
            [batch.column("_key"), pa.array(counts), pa.array(target), pa.array(background), pa.array(target - background)],
            names=[key, "n_tokens", "target_loss", "background_loss", "score"],
        )

    scored = StructType(
        [
            StructField(key, rows.schema["_key"].dataType),
            StructField("n_tokens", LongType()),
            *[StructField(c, DoubleType()) for c in ("target_loss", "background_loss", "score")],
        ]
    )
    return (
        rows.select("_key", "_text", "_row", "_batch")
        .groupBy("_batch")
        .cogroup(answers.where("_batch >= 0").drop("_words", "_total", "_totals").groupBy("_batch"))
        .applyInArrow(score, scored)
    )
