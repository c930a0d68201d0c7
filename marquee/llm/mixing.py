"""Mixing sources to target weights along a van der Corput sequence of equal-token blocks."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.llm.shared import identified, join_groups
from marquee.session import durable

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]*"
#: Words in a block.
BLOCK_WORDS = 128
#: Shuffled documents of a source are summed in 2^BUCKET_BITS buckets.
BUCKET_BITS = 12
#: Consecutive slots that are ranked together.
SLOTS_TOGETHER = 1 << 16


class Mix(NamedTuple):
    """What a mix consists of.

    sources: one row per source with size, target and shares.
    documents: one row per document with size, source facts and ``taken`` words.
    schedule: one row per slot: position, source, block, words and pass over the source.
    spans: one row per slot and document in it: position, pass, block, key, first word, words.
    """

    sources: DataFrame
    documents: DataFrame
    schedule: DataFrame
    spans: DataFrame


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Target words of each source, by weights that repeat in code point order, null last.

    The targets add up to ``share`` of all words.  One that exceeds ``most`` times its source
    stops there, and the excess goes to the others by weight until none is above.  Seen in
    order of limit over weight, the sources that stop come first, so one running sum finds
    the common level.  There is one row per source here, not per document.
    """
    turn = F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("_no", turn).withColumn(
        "_weight", F.element_at(listed, F.col("_no") % len(weights) + 1)
    )
    limit = F.col("_size") * F.lit(float(most))
    ordered = Window.orderBy(limit / F.col("_weight"), "_no")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum(limit).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_weight").over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("_size").over(everything) * F.lit(float(share)) - before) / rest
    levelled = ranked.withColumn("_level", level)
    open_level = F.when(limit / F.col("_weight") > F.col("_level"), F.col("_level"))
    # The first source that does not stop has the common level; without one, all stop.
    first_open = F.first(open_level, ignorenulls=True).over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(limit, F.coalesce(first_open * F.col("_weight"), limit))
    return levelled.withColumn("_target", target).drop("_level")


def _reversed_bits(number: Column, bits: int) -> Column:
    """The lowest ``bits`` bits of a number in reverse order: van der Corput in base 2."""
    for width, mask in (
        (1, 0x5555555555555555),
        (2, 0x3333333333333333),
        (4, 0x0F0F0F0F0F0F0F0F),
        (8, 0x00FF00FF00FF00FF),
        (16, 0x0000FFFF0000FFFF),
        (32, 0x00000000FFFFFFFF),
    ):
        right = F.shiftrightunsigned(number, width).bitwiseAND(F.lit(mask))
        number = right.bitwiseOR(F.shiftleft(number.bitwiseAND(F.lit(mask)), width))
    return F.shiftrightunsigned(number, 64 - bits)


def _running(rows: DataFrame, by: list[str], bucket: str, order: list[str], amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over the rows before, within ``by``, in order of bucket and ``order``.

    Buckets are summed first, so no single task sees all rows of a large group.
    """
    before = Window.unboundedPreceding
    sums = rows.groupBy(*by, bucket).agg(F.sum(amount).alias("_in"))
    starts = sums.select(
        *by,
        bucket,
        F.coalesce(F.sum("_in").over(Window.partitionBy(*by).orderBy(bucket).rowsBetween(before, -1)), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(before, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(starts, [*by, bucket])
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_start", "_inside")
    )


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Slots of the mix: _position, _no, _pass, _block, _words.

    A source needs one slot per block it delivers.  With M slots in all, the 2^k >= M van der
    Corput points visit 2^k equal cells once each; every source owns the cells of its interval
    of the cumulative weights, at least as many as it needs.  Its points, ranked in the order
    of the sequence, are its slots; the last block is cut at the target.
    """
    facts = sources.select(
        "_no", F.col("_size").alias("_s"), F.round("_target").cast("bigint").alias("_t")
    ).where("_s > 0 AND _t > 0")
    facts = facts.select(
        "*",
        F.ceil(F.col("_s") / block_words).cast("bigint").alias("_blocks"),
        F.expr("_t div _s").alias("_whole"),
    ).withColumn(
        "_need",
        F.col("_whole") * F.col("_blocks")
        + F.ceil((F.col("_t") - F.col("_whole") * F.col("_s")) / block_words).cast("bigint"),
    )
    slots = facts.agg(F.sum("_need")).first()[0] or 0
    bits = max(1, (slots - 1).bit_length()) if slots else 1
    upto = F.sum(F.col("_need").cast("decimal(38,0)")).over(Window.orderBy("_no"))
    edge = lambda c: F.expr(f"CAST(({c}) * {1 << bits}BD div {max(slots, 1)} AS BIGINT)")
    cells = (
        facts.withColumn("_upto", upto)
        .withColumn("_first", edge("_upto - _need"))
        .withColumn("_last", edge("_upto") - 1)
    )
    pieces = cells.select(
        "*",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_last - _first) div {SLOTS_TOGETHER}"))).alias("_part"),
    ).repartition("_no", "_part")
    low = F.col("_first") + F.col("_part") * SLOTS_TOGETHER
    points = pieces.select(
        "_no", "_s", "_t", "_blocks", "_need",
        F.explode(F.sequence(low, F.least(F.col("_last"), low + (SLOTS_TOGETHER - 1)))).alias("_cell"),
    ).select(
        "_no", "_s", "_t", "_blocks", "_need",
        _reversed_bits(F.col("_cell"), bits).alias("_position"),
        F.lit(1).cast("bigint").alias("_one"),
    ).withColumn("_bucket", F.expr(f"_position div {SLOTS_TOGETHER}"))
    ranked = _running(points, ["_no"], "_bucket", ["_position"], "_one", "_rank")
    placed = ranked.where("_rank < _need").select(
        "_position", "_no", "_s", "_t",
        F.expr("_rank div _blocks").alias("_pass"),
        F.expr("_rank % _blocks").alias("_block"),
    )
    start = F.col("_block") * block_words
    words = F.least(
        F.lit(block_words).cast("bigint"),
        F.col("_s") - start,
        F.col("_t") - F.col("_pass") * F.col("_s") - start,
    )
    return placed.select("_position", "_no", "_pass", "_block", words.alias("_words")).where("_words > 0")


def _thin(docs: DataFrame, key: str, text: str, source: str, seed: int, *row: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key).alias("_key"),
        F.col(source).alias("_source"),
        F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("_size"),
        F.xxhash64(F.lit(seed), F.col(key), body).alias("_order"),
        _source_key(F.col(source)).alias("_name"),
        *row,
    )


def _mix(thin: DataFrame, weights: Sequence[float], share: float, most: float, block_words: int) -> _Mixed:
    total = thin.count()
    sums = thin.groupBy("_name").agg(
        F.first("_source").alias("_source"),
        F.sum("_size").alias("_size"),
        F.count("*").alias("_docs"),
    )
    sources = durable(targets(sums, weights, share, most))
    known = join_groups(thin, sources.drop("_source"), "_name", "_docs", total).select(
        "_key", "_source", "_size", "_order", "_row",
        F.col("_facts._no").alias("_no"),
        F.col("_facts._size").alias("_source_size"),
        F.col("_facts._target").alias("_target"),
    )
    shuffled = known.where("_size > 0").withColumn(
        "_bucket", F.shiftrightunsigned("_order", 64 - BUCKET_BITS)
    )
    placed = _running(shuffled, ["_no"], "_bucket", ["_order", "_key", "_row"], "_size", "_from")
    slots = durable(schedule(sources, block_words))
    pieces = placed.select("_row", "_key", "_no", "_size", "_from", F.explode(_blocks(block_words)).alias("_block"))
    begin = F.col("_block") * block_words
    first = F.greatest(F.col("_from"), begin)
    end = F.least(F.col("_from") + F.col("_size"), begin + F.col("_words"))
    spans = (
        pieces.join(slots, ["_no", "_block"])
        .select(
            "_position", "_no", "_pass", "_block", "_row", "_key", "_from",
            (first - F.col("_from")).alias("_first"), (end - first).alias("_got"),
        )
        .where("_got > 0")
    )
    taken = spans.groupBy("_row").agg(F.sum("_got").alias("_taken"))
    documents = known.join(taken, "_row", "left").withColumn(
        "_taken", F.coalesce("_taken", F.lit(0).cast("bigint"))
    )
    return _Mixed(sources, documents, slots, spans, placed)


class _Mixed(NamedTuple):
    """A mix under private names, and the words of a source before each of its documents."""

    sources: DataFrame
    documents: DataFrame
    slots: DataFrame
    spans: DataFrame
    placed: DataFrame


def _blocks(block_words: int) -> Column:
    """The blocks of its source that a document with words lies in."""
    return F.sequence(F.expr(f"_from div {block_words}"), F.expr(f"(_from + _size - 1) div {block_words}"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    seed: int = 42,
) -> Mix:
    """Mix the sources of ``docs`` to weighted targets.

    Sources in code point order, null last, weigh ``weights``, repeating.  Together they give
    ``share`` of all words and none more than ``most`` times its own.  Documents of a source
    are shuffled by a seeded hash of key and text, cut into blocks of ``block_words`` words
    (the last one shorter) and passed over in that order, again where the target asks for
    more than the source has; the last slot is cut so that a source gives its rounded target
    to the word.

    A null text has no words and is never taken; neither are documents of a source without
    words, whose target is 0.  Repeated rows count as rows of their own.  Same input and
    seed, same mix, but that rows with the same key and text may swap turns.  An empty table
    gives empty results.  Other columns are ignored.
    """
    thin = durable(_thin(docs, key, text, source, seed, F.monotonically_increasing_id().alias("_row")))
    mixed = _mix(thin, weights, share, most, block_words)
    documents = mixed.documents.select(
        F.col("_key").alias(key),
        F.col("_source").alias(source),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        F.col("_taken").alias("taken"),
    )
    spans = mixed.spans.select(
        F.col("_position").alias("position"),
        F.col("_pass").alias("pass"),
        F.col("_block").alias("block"),
        F.col("_key").alias(key),
        F.col("_first").alias("first_word"),
        F.col("_got").alias("words"),
    )
    return Mix(mixed.sources, documents, mixed.slots, spans)


def mixed_blocks(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    seed: int = 42,
) -> DataFrame:
    """The text of the mix in its order: position, source, pass, block, words, spans, text.

    One row per slot of the schedule, sorted by ``position``, so that every beginning of the
    result holds nearly the weighted share of each source.  A slot gives the words of its block
    with the white space that follows each; where a document ends within the block a line feed
    stands before the next one.  ``spans`` lists the key, first word and words of each document.

    Texts meet their places once, are cut into blocks there, and only cut words travel on, once
    for each pass over the source; a slot holds ``block_words`` words at most.  Cases as for
    :func:`mix`; an empty table, or one without words, gives no rows.
    """
    kept = durable(
        identified(docs, F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(source).alias("_source"))
    )
    thin = _thin(kept, "_key", "_text", "_source", seed, "_row")
    mixed = _mix(durable(thin), weights, share, most, block_words)
    parts = F.regexp_extract_all(F.col("_text"), F.lit(f"{WORD}{GAP}"), F.lit(0))
    cut = F.transform(
        _blocks(block_words),
        lambda b: F.struct(
            b.alias("_block"),
            F.greatest(F.lit(0), b * block_words - F.col("_from")).alias("_first"),
            F.slice(
                "_parts",
                (F.greatest(F.lit(0), b * block_words - F.col("_from")) + 1).cast("int"),
                (
                    F.least(F.col("_size"), (b + 1) * block_words - F.col("_from"))
                    - F.greatest(F.lit(0), b * block_words - F.col("_from"))
                ).cast("int"),
            ).alias("_words_of"),
        ),
    )
    pieces = (
        mixed.placed.select("_row", "_key", "_source", "_no", "_size", "_from")
        .join(kept.select("_row", "_text"), "_row")
        .withColumn("_parts", parts)
        .select("_row", "_key", "_source", "_no", "_from", F.inline(cut))
    )
    left = F.col("_words") - F.greatest(F.lit(0), F.col("_from") - F.col("_block") * block_words)
    got = F.least(left, F.size("_words_of").cast("bigint"))
    span = F.struct(
        F.col("_from"), F.col("_row"), F.col("_key").alias(key), F.col("_first").alias("first_word"),
        got.alias("words"), F.array_join(F.slice("_words_of", F.lit(1), got.cast("int")), "").alias("_piece"),
    )
    slots = (
        pieces.join(mixed.slots, ["_no", "_block"])
        .where(left > 0)
        .groupBy("_position", "_no", "_pass", "_block", "_words")
        .agg(F.first("_source").alias("_source"), F.sort_array(F.collect_list(span)).alias("_spans"))
    )
    return slots.select(
        F.col("_position").alias("position"),
        F.col("_source").alias("source"),
        F.col("_pass").alias("pass"),
        F.col("_block").alias("block"),
        F.col("_words").alias("words"),
        F.transform("_spans", lambda s: F.struct(s[key], s["first_word"], s["words"])).alias("spans"),
        F.array_join(F.transform("_spans", lambda s: s["_piece"]), "\n").alias("text"),
    ).orderBy("position")


def mixed_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    block_words: int = BLOCK_WORDS,
    seed: int = 42,
) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: a row for each pass over a document.

    Row order is free; :func:`mixed_blocks` gives the order of the mix.  A pass that the target cuts short, at most one document per source,
    gives the document's first words; every other pass gives its whole text.  ``n_chars``,
    where present, is counted anew.  Columns stay as they are; cases as for :func:`mix`.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    kept = durable(identified(docs, whole))
    thin = _thin(kept, f"_doc.{key}", f"_doc.{text}", f"_doc.{source}", seed, "_row")
    taken = _mix(durable(thin), weights, share, most, block_words).documents.where("_taken > 0")
    passes = kept.join(taken.select("_row", "_size", "_taken"), "_row").select(
        "_doc", "_size",
        F.explode(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.expr("(_taken - 1) div _size")),
                lambda p: F.least(F.col("_size"), F.col("_taken") - p * F.col("_size")),
            )
        ).alias("_words"),
    )
    parts = F.regexp_extract_all(F.col(f"_doc.{text}"), F.lit(f"{WORD}{GAP}"), F.lit(0))
    cut = F.array_join(F.slice(parts, F.lit(1), F.col("_words").cast("int")), "")
    whole_pass = F.col("_words") == F.col("_size")
    passes = passes.withColumn("_text", F.when(whole_pass, F.col(f"_doc.{text}")).otherwise(cut))
    kinds = dict(docs.dtypes)
    out = []
    for c in docs.columns:
        value = F.col(f"_doc.`{c}`")
        if c == text:
            value = F.col("_text")
        elif c == "n_chars":
            value = F.when(value.isNotNull(), F.length("_text").cast(kinds[c]))
        out.append(value.alias(c))
    return passes.select(*out)
