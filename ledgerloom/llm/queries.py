"""The registered queries of this folder: name to a function of session and data folder.

Each applies one operator, with the parameters it would run with, to its whole table.
"""

from pyspark.sql import functions as F

from ledgerloom.llm import (
    bpe,
    conversation_repair,
    decontaminate,
    lexical_search,
    mixing,
    pii,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
    training_order,
)
from ledgerloom.llm.oracle import ORACLE
from ledgerloom.session import work_path

__all__ = ["ORACLE", "QUERIES"]

KEY = "corpus-key-1"
TOKENIZER = "word_bpe_49k.json"

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name=TOKENIZER):
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query
def op1_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    replaced = pii.pseudonymise(docs, KEY, counts_col="counts")
    kinds = F.array_sort(F.map_keys("counts"))
    return replaced.select(
        "doc_id",
        "text",
        F.aggregate(F.map_values("counts"), F.lit(0), lambda a, n: a + n).cast("long").alias("n_replaced"),
        F.array_join(kinds, ",").alias("kinds"),
    )


@query
def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


@query
def op5_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_sharding(spark, sf_dir):
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


@query
def op7_bpe(spark, sf_dir):
    path = tokenizer_path()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), path, decode_into="decoded")
    return encoded.select("doc_id", *bpe.digests())


@query
def op4_training_order(spark, sf_dir):
    path = work_path(spark, "training-order")
    docs = table(spark, sf_dir, "documents")
    return training_order.materialise(docs, path, KEY, tokenizer=tokenizer_path())


@query
def op8_suffix_dedup(spark, sf_dir):
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    size = F.octet_length("text").cast("long")
    return left.select(
        "doc_id",
        size.alias("n_bytes"),
        (size - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op9_token_counts(spark, sf_dir):
    path = tokenizer_path("piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), path)


@query
def op10_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query
def op11_mixing(spark, sf_dir):
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


@query
def op12_lexical_search(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_conversation_repair(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    repaired = conversation_repair.repair(conversation_repair.damaged(turns))
    return conversation_repair.with_all_conversations(repaired, turns)
