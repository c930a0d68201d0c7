"""Exact deduplication by a two-pass Bloom filter, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.shared import identified, join_groups
from marquee.session import durable

#: Bloom filter: 64-bit words, each row sets two bits in one of them.
ROWS_PER_WORD = 4
#: Bound of the broadcast filter (words).  Beyond 4 rows a word more unrepeated rows are
#: shuffled as possible repeats; the result stays the same.
MAX_WORDS = 1 << 21


def _word(hash_: Column, words: int) -> Column:
    return hash_.bitwiseAND(F.lit(words - 1))


def _mask(hash_: Column) -> Column:
    """Two bits of the word, from hash bits that do not choose the word."""
    one = F.lit(1).cast("bigint")

    def bit(at: int) -> Column:
        place = F.shiftrightunsigned(hash_, at).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", one, place)

    return bit(52).bitwiseOR(bit(58))


def repeated_bits(hashes: DataFrame, words: int) -> DataFrame:
    """First pass: per filter word, the bits that two or more rows set (``_twice``).

    Rows of one word are first counted by mask, so a word holds at most 2,080 entries however
    often a text occurs.
    """
    zero = F.lit(0).cast("bigint")
    entries = (
        hashes.select(_word(F.col("_hash"), words).alias("_word"), _mask(F.col("_hash")).alias("_mask"))
        .groupBy("_word", "_mask")
        .agg(F.count("*").alias("_n"))
        .groupBy("_word")
        .agg(F.collect_list(F.struct("_mask", "_n")).alias("_entries"))
    )

    def insert(state: Column, entry: Column) -> Column:
        again = F.when(entry["_n"] > 1, entry["_mask"]).otherwise(state["once"].bitwiseAND(entry["_mask"]))
        return F.struct(
            state["once"].bitwiseOR(entry["_mask"]).alias("once"),
            state["twice"].bitwiseOR(again).alias("twice"),
        )

    start = F.struct(zero.alias("once"), zero.alias("twice"))
    twice = F.aggregate("_entries", start, insert, lambda s: s["twice"])
    return entries.select("_word", twice.alias("_twice")).where(F.col("_twice") != 0)


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, a null text being an empty one.  Of equal texts the row
    with the largest key stays, a null key being the smallest; of repeated rows with one key
    exactly one stays.  Other columns are ignored.  An empty table gives no rows.

    A row whose bits nobody else set passes straight through.  Only digests of possible
    repeats are shuffled, texts never.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    thin = durable(
        identified(docs, F.col(key).alias("_key"), digest.alias("_sha")).withColumn(
            "_hash", F.xxhash64("_sha")
        )
    )
    total = thin.count()
    words = 1
    while words * ROWS_PER_WORD < total and words < MAX_WORDS:
        words *= 2
    # At most MAX_WORDS rows of two numbers.
    repeats = F.broadcast(durable(repeated_bits(thin, words)))
    bits = _mask(F.col("_hash"))
    tested = thin.withColumn("_word", _word(F.col("_hash"), words)).join(repeats, "_word", "left")
    tested = tested.withColumn(
        "_possible", F.coalesce(F.col("_twice").bitwiseAND(bits) == bits, F.lit(False))
    )
    columns = ["_key", "_sha", "_row"]
    single = tested.where(~F.col("_possible")).select(
        F.col("_key").alias(key),
        F.col("_key").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    possible = tested.where("_possible").select(*columns)
    groups = possible.groupBy("_sha").agg(
        F.max(F.struct("_key", "_row")).alias("_keep"), F.count("*").alias("_n")
    )
    grouped = join_groups(possible, groups, "_sha", "_n", total).select(
        F.col("_key").alias(key),
        F.col("_facts._keep._key").alias("keep_id"),
        F.col("_facts._n").alias("group_size"),
        (F.col("_row") == F.col("_facts._keep._row")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    return single.unionByName(grouped)
