"""The registered query of each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, common, decontaminate, exact, html_text, langid, lm, merkle, mixing, pii, quality, simhash, substring


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return lm.score_texts(docs, common.id_remainder("doc_id", 7) != 2).withColumnRenamed("id", "doc_id")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(_read(spark, sf_dir, "documents"), window=35)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("start").alias("match_start"), F.col("end").alias("match_end"), "edits")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_read(spark, sf_dir, "documents"), shingle_words=3, radius=2, seed=42)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs, weights=(5, 2, 1), share=1.5, max_epochs=2.0).select("doc_id", "size", "source_size", "target", "taken")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, common.id_remainder("doc_id", 3) != 1).withColumnRenamed("id", "doc_id")


def _span_list(spans: str):
    names = F.array(*[F.lit(k) for k in pii.KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_spans(_read(spark, sf_dir, "documents"))
    of_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(pii.BASE_KINDS)]
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(_span_list("base"), 256).alias("base_sha256"), _span_list("spans").alias("spans"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_main_text(_read(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"select cast(-1 as bigint) conv_id, cast(t as bigint) turn, r role, '{said}' text from values (0, 'user'), (1, 'assistant') as x(t, r)")
    out = chat.read_back(chat.format_chats(turns.unionByName(extra)))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment.align_texts(_read(spark, sf_dir, "documents"), digest=True)
    return out.withColumnsRenamed({"id": "doc_id", "groups": "groups_sha256"})


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    capitals = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    out = merkle.audit(
        _read(spark, sf_dir, "documents"),
        columns=("doc_id", "source", "lang", "n_chars", "text"),
        tampered={"text": F.translate("text", capitals, capitals.lower())},
        where=common.id_remainder("doc_id", 3) == 0,
    )
    folded = F.coalesce(F.try_element_at("nodes", F.lit(-1)), F.col("version_leaf"))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"), "verified")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_substring_dedup, op3_decontamination, op4_simhash, op5_mixing, op6_language_id, op7_pii, op8_html_text, op9_quality_rules, op10_chat_format, op11_token_alignment, op12_merkle_manifest, op13_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return dict(oracle.SQL)
