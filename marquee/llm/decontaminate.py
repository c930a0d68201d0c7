"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.session import durable

#: Spaced seeds: the token offsets that a mask compares; those between are ignored.  Together
#: they hit every run of 13 tokens with up to two substitutions (all 78 cases tried out).
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 6, 8, 9))
#: A passage is a run of this many tokens (all, of a shorter item) ...
PASSAGE = 13
#: ... in which at least this share agrees with the item, position by position.
AGREE = 0.8
#: The filter of benchmark hashes has 64 bits in each of at most this many words.
FILTER_BITS = 26
OTHER = r"[^\p{L}\p{N}]+"


def masks_of(length: int) -> tuple[tuple[int, ...], ...]:
    """Masks over a whole item of fewer than PASSAGE tokens; one of them is free of its substitutions.

    The item is cut into two blocks more than it may have substitutions and each mask leaves out as
    many blocks as there may be; so whatever blocks are hit, a mask of the others remains.  An item
    that may have none has one mask over all of its tokens.
    """
    spared = length - math.ceil(length * AGREE)
    if not spared:
        return (tuple(range(length)),)
    parts = spared + 2
    blocks = [range(i * length // parts, (i + 1) * length // parts) for i in range(parts)]
    return tuple(
        tuple(o for i, block in enumerate(blocks) if i not in left_out for o in block)
        for left_out in combinations(range(parts), spared)
    )


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; none for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), OTHER), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _windows(rows: DataFrame, masks: Sequence[tuple[int, tuple[int, ...]]], *keep: str) -> DataFrame:
    """A row per mask and position of ``_tokens``: keep, _pos, _mask, _hash; masks are (number, offsets).

    Shifted copies of the token array are zipped, so each position carries the tokens of its
    window and hashing them needs no lambda.
    """
    offsets = sorted({o for _, m in masks for o in m})
    size = F.size("_tokens")
    shifted = [
        F.slice("_tokens", F.lit(o + 1), F.greatest(size - o, F.lit(0))).alias(f"t{o}") for o in offsets
    ]
    zipped = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted)).alias("_pos", "_t"))
    seeds = F.array(
        *[
            F.when(
                F.col(f"_t.t{m[-1]}").isNotNull(),
                F.struct(
                    F.lit(k).alias("_mask"),
                    F.xxhash64(F.lit(k), *[F.col(f"_t.t{o}") for o in m]).alias("_hash"),
                ),
            )
            for k, m in masks
        ]
    )
    return (
        zipped.select(*keep, "_pos", F.explode(seeds).alias("_seed"))
        .where("_seed IS NOT NULL")
        .select(*keep, "_pos", "_seed._mask", "_seed._hash")
    )


def _place(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 64 - FILTER_BITS)


def _bit(hash_: Column) -> Column:
    one = F.lit(1).cast("bigint")
    return F.call_function("shiftleft", one, _place(hash_).bitwiseAND(F.lit(63)).cast("int"))


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Passages of the benchmark in documents: key, item, passage_words, agreeing, doc_word, item_word.

    One row per document and item that share a passage: PASSAGE tokens in a row (all tokens of
    a shorter item) of which a share of AGREE or more agrees at equal positions; the best one
    is described, the first among equals.  Tokens are lower-cased runs of letters and digits.
    Tokens under the spaced seeds of both sides are hashed and the hashes joined; each hit is
    then verified around its place, so substituted tokens are tolerated and chance hits fall.

    Rows with one key are one document: a passage in any of them counts.  Null keys and items
    are values like others.  Null texts and texts without tokens share no passage.  An item of
    fewer than PASSAGE tokens has masks of its own over all of its tokens, which no permitted
    number of substitutions can all hit; only lengths that the benchmark has are looked for.
    Repeated items are reported once per item.  Other columns are ignored; an empty table gives
    no rows.
    """
    items = durable(
        benchmark.select(F.col(item).alias("_item"), tokens(F.col(item_text)).alias("_item_tokens"))
        .where(F.size("_item_tokens") > 0)
        .distinct()
        .withColumn("_no", F.monotonically_increasing_id())
    )
    size = F.least(F.size("_item_tokens"), F.lit(PASSAGE))
    # At most PASSAGE different lengths.
    lengths = sorted(r[0] for r in items.select(size).distinct().collect())
    named = {n: MASKS if n == PASSAGE else masks_of(n) for n in lengths}
    numbered = list(enumerate((n, m) for n in lengths for m in named[n]))
    masks = [(k, m) for k, (_, m) in numbered]
    of_length = [
        _windows(
            items.where(size == n).withColumnRenamed("_item_tokens", "_tokens"),
            [(k, m) for k, (other, m) in numbered if other == n],
            "_no",
        )
        for n in lengths
    ]
    if not of_length:
        of_length = [_windows(items.withColumnRenamed("_item_tokens", "_tokens"), list(enumerate(MASKS)), "_no")]
        masks = list(enumerate(MASKS))
    # A shorter item is matched as a whole, so its masks begin at its first token.
    every = reduce(DataFrame.unionByName, of_length)
    whole = [k for k, (n, _) in numbered if n < PASSAGE]
    wanted = durable(every.where(~F.col("_mask").isin(whole) | (F.col("_pos") == 0)).withColumnRenamed("_pos", "_at"))
    # At most 2^(FILTER_BITS - 6) rows of two numbers, however large the benchmark.
    bits = F.broadcast(
        wanted.groupBy(F.shiftrightunsigned(_place(F.col("_hash")), 6).alias("_word"))
        .agg(F.bit_or(_bit(F.col("_hash"))).alias("_bits"))
    )
    known = docs.select(F.col(key).alias("_key"), tokens(F.col(text)).alias("_tokens"))
    hits = (
        _windows(known, masks, "_key")
        .withColumn("_word", F.shiftrightunsigned(_place(F.col("_hash")), 6))
        .join(bits, "_word")
        .where(F.col("_bits").bitwiseAND(_bit(F.col("_hash"))) != 0)
        .select("_key", "_pos", "_mask", "_hash")
    )
    # Hits on one diagonal are one place to look at, from the first to the last of them.
    places = durable(
        hits.join(wanted, ["_mask", "_hash"])
        .groupBy("_key", "_no", (F.col("_pos") - F.col("_at")).alias("_shift"))
        .agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    )
    candidates = places.join(items, "_no").withColumnRenamed("_key", "_k")
    found = known.join(candidates, F.col("_key").eqNullSafe(F.col("_k")))
    length = F.least(F.size("_item_tokens"), F.lit(PASSAGE))
    begin = F.greatest(F.col("_first") - length, F.lit(0), -F.col("_shift"))
    end = F.least(F.col("_last") + 2 * PASSAGE, F.size("_item_tokens"), F.size("_tokens") - F.col("_shift"))
    compared = found.select(
        "_key", "_item", "_shift", length.alias("_len"), begin.alias("_begin"),
        F.zip_with(
            F.slice("_item_tokens", begin + 1, F.greatest(end - begin, F.lit(0))),
            F.slice("_tokens", F.greatest(begin + F.col("_shift"), F.lit(0)) + 1, F.greatest(end - begin, F.lit(0))),
            lambda a, b: F.when(a == b, 1).otherwise(0),
        ).alias("_same"),
    ).where("size(_same) >= _len")
    # Agreeing tokens of each window, by a running sum; the last best one.
    windows = F.transform(
        F.sequence(F.lit(1), F.size("_same") - F.col("_len") + 1),
        lambda i: F.struct(
            F.aggregate(F.slice("_same", i, F.col("_len")), F.lit(0), lambda a, x: a + x).alias("n"),
            (-i).alias("i"),
        ),
    )
    best = compared.select("_key", "_item", "_shift", "_len", "_begin", F.array_max(windows).alias("_best"))
    passages = best.where(F.col("_best.n") >= F.ceil(F.col("_len") * AGREE)).select(
        "_key", "_item",
        F.struct(
            F.col("_best.n").alias("n"),
            (F.col("_best.i") + 1 - F.col("_begin") - F.col("_shift")).alias("doc"),
            (F.col("_best.i") + 1 - F.col("_begin")).alias("item"),
            F.col("_len").alias("len"),
        ).alias("_p"),
    )
    return passages.groupBy("_key", "_item").agg(F.max("_p").alias("_p")).select(
        F.col("_key").alias(key),
        F.col("_item").alias(item),
        F.col("_p.len").alias("passage_words"),
        F.col("_p.n").alias("agreeing"),
        (-F.col("_p.doc")).alias("doc_word"),
        (-F.col("_p.item")).alias("item_word"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose document shares no passage with the benchmark; all columns."""
    leaked = durable(
        contaminated(docs, benchmark, key, **options).select(F.col(key).alias("_leaked")).distinct()
    )
    return docs.join(leaked, docs[key].eqNullSafe(leaked["_leaked"]), "left_anti")


