"""The operators' queries over the whole tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, jaccard, language, mixing, neighbours, secrets, token_files, toxicity

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat(spark, sf_dir):
    text = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own))


def op4_mix(spark, sf_dir):
    return mixing.mix_table(table(spark, sf_dir, "documents"))


def op5_jaccard(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op6_secrets(spark, sf_dir):
    return secrets.secret_table(table(spark, sf_dir, "documents"))


def op7_tokens(spark, sf_dir):
    return token_files.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op9_html(spark, sf_dir):
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op10_language(spark, sf_dir):
    return language.language_table(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_decontaminate, op2_toxicity, op3_chat, op4_mix, op5_jaccard, op6_secrets, op7_tokens, op8_nearest, op9_html, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat.CHAT_SQL, "op4_mix": mixing.MIX_SQL, "op5_jaccard": jaccard.JACCARD_SQL}
