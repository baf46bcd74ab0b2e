"""From raw documents to token ids: the five stages, each written and read again.

Every stage works on all that the stage before kept. All but the last return the columns of
`documents`; toxic documents, all but one of a group of near-duplicates, and documents that hold
benchmark passages are left out, and personal values are replaced.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, decontaminate, pii, simhash, toxicity
from ledgerloom.llm.queries import KEY, table, tokenizer_path
from ledgerloom.session import work_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def replace_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal values; `n_chars` follows the text."""
    replaced = pii.pseudonymise(docs, KEY)
    if "n_chars" in replaced.columns:
        kind = replaced.schema["n_chars"].dataType
        replaced = replaced.withColumn(
            "n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind)
        )
    return replaced


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the whole text, their number, and digests of ids and decoded text."""
    path = tokenizer_path()
    encoded = bpe.encode(docs, path, decode_into="decoded")
    return encoded.select("doc_id", "ids", *bpe.digests())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pii", replace_personal),
    ("bpe", to_tokens),
]

# A trained model, SimHash components and a tokenizer: no stage but the fourth's length is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name.replace(" ", "-"))
        result = stage(spark, docs, sf_dir)
        result.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
