"""Registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.decontaminate import contaminated
from marquee.llm.dedup import exact_dedup
from marquee.llm.html_text import extract_text
from marquee.llm.jaccard import jaccard_components
from marquee.llm.lm_score import score_lm
from marquee.llm.mixing import mix
from marquee.llm.pack import pack
from marquee.llm.periodic import periodic_runs
from marquee.llm.quality import score_quality
from marquee.llm.repair import repair
from marquee.llm.shared import read
from marquee.llm.tokens import read_tokens, write_tokens
from marquee.llm.toxicity import score_toxicity
from marquee.llm.warc import read_archives, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = build
        if sql is not None:
            ORACLE[key] = sql
        return build

    return register


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_token_ids")
def op1(spark: SparkSession, directory: str) -> DataFrame:
    written = write_tokens(read(spark, directory, "documents"), tokenizer_path())
    return read_tokens(written, with_ids=False)


@query("op2_toxicity")
def op2(spark: SparkSession, directory: str) -> DataFrame:
    return score_toxicity(read(spark, directory, "documents"), read(spark, directory, "labels"))


@query("op3_warc")
def op3(spark: SparkSession, directory: str) -> DataFrame:
    archives = write_archives(read(spark, directory, "pages"))
    found = read_archives(archives, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_mix_sources")
def op4(spark: SparkSession, directory: str) -> DataFrame:
    documents = mix(read(spark, directory, "documents")).documents
    return documents.select("doc_id", "size", "source_size", "target", "taken")


@query("op5_lm_score")
def op5(spark: SparkSession, directory: str) -> DataFrame:
    trusted = read(spark, directory, "labels").where("quality = 1")
    return score_lm(read(spark, directory, "documents"), trusted)


@query("op6_jaccard_join")
def op6(spark: SparkSession, directory: str) -> DataFrame:
    return jaccard_components(read(spark, directory, "documents"), width=3, num=90, den=100)


@query("op7_html_text")
def op7(spark: SparkSession, directory: str) -> DataFrame:
    return extract_text(read(spark, directory, "pages"))


@query("op8_decontaminate")
def op8(spark: SparkSession, directory: str) -> DataFrame:
    return contaminated(read(spark, directory, "documents"), read(spark, directory, "benchmark"))


@query("op9_quality")
def op9(spark: SparkSession, directory: str) -> DataFrame:
    return score_quality(read(spark, directory, "documents"), read(spark, directory, "labels"))


@query(
    "op10_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op10(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup(read(spark, directory, "documents"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """Documents in which every tenth id by checksum repeats a stretch of its words up to the end.

    With h = crc32(doc_id) and g = h div 10, the words from a = g % n on become those of a period of
    1 + (n - a) div (3 + g % 8) words.  Texts without words and rows without an id stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    parts = docs.select("doc_id", "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_words"))
    parts = parts.withColumns({"_n": F.size("_words").cast("long"), "_g": F.expr("_h div 10")})
    planted = (F.col("_h") % 10 == 0) & (F.col("_n") > 0)
    parts = parts.withColumn("_a", F.when(planted, F.col("_g") % F.col("_n")))
    parts = parts.withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    repeated = F.expr(
        "array_join(concat(slice(_words, 1, int(_a)), slice(flatten(array_repeat(slice(_words, int(_a) + 1, int(_p)), "
        "int((_n - _a + _p - 1) div _p))), 1, int(_n - _a))), ' ')"
    )
    return parts.select("doc_id", F.when(planted, repeated).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, directory: str) -> DataFrame:
    found = periodic_runs(with_planted_repeats(read(spark, directory, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    best = found.withColumn("_best", longest)
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.s")).alias("start"),
        F.col("_best.n").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("1000 * _best.n div -_best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults chosen by crc32(``conv_id:turn``) % 20; ``_kept`` is false for dropped ones.

    0 drops, 1 empties the text, 2 removes its sentence ends, 3 repeats the row, 4 makes it a user's.
    Nulls count as one blank.
    """
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    case, text = F.crc32(name) % 20, F.coalesce("text", blank)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(case == 4, F.lit("user")).otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(case == 1, F.lit("")).when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (case != 0).alias("_kept"),
        F.explode(F.array_repeat(F.lit(0), F.when(case == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


@query("op12_repair_conversations")
def op12(spark: SparkSession, directory: str) -> DataFrame:
    return repair(damaged(read(spark, directory, "conversations")), present=F.col("_kept"))


@query("op13_pack_sequences")
def op13(spark: SparkSession, directory: str) -> DataFrame:
    return pack(read(spark, directory, "documents"), tokenizer_path())
