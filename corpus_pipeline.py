"""The corpus pipeline: language ID, SimHash near-duplicates, benchmark decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run`` writes each stage's
result as Parquet in the shared folder and rereads it as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgrid.llm import decontamination, language, mixing, simhash, token_files
from claimgrid.llm.common import crc_mod, shared_dir, table, written

#: Columns of documents; every stage but the last returns them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL has the language model, the fingerprints' hash or the tokenizer.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told (null, empty or letterless text) and writes the predicted language into ``lang`` where it is missing.

    Rows with a null ``lang`` teach nothing; where no row has one, all documents with a letter stay and ``lang`` stays null. A null doc_id is as good as
    any; repeated rows all stay; an empty table stays empty; other columns go.
    """
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = language.train(docs, ~held)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.predict(docs, model, keep=COLUMNS)
    return found.where(F.col("lang_pred") != language.UND).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that with the smallest doc_id (null last), then hash of the text, then place.

    Rows are told apart by a row number, so rows with equal or null doc_ids and unlike texts all stay; of repeated rows one stays; null, empty and
    blank texts are one group; an empty table stays empty; other columns go.
    """
    rows = written(docs.select(*COLUMNS).withColumn("__row", F.monotonically_increasing_id()), "near-dedup-rows")
    found = simhash.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("text"), "__row")
    heads = found.join(rows.select("__row", order.alias("order")), "__row").groupBy("component_id").agg(F.min("order").alias("order"))
    return rows.join(heads.select(F.col("order.__row").alias("__row")), "__row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the contamination rule names; all others stay whole, those with null and empty texts, null doc_ids and repeated rows, too. An empty benchmark drops nothing; other columns go."""
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.withColumn("n_hit", decontamination.n_hit()).where(~decontamination.contaminated()).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch in which the mix takes words of a document: whole texts as they are, cut ones with the words that are taken.

    Null, empty and blank texts have no words and are never taken; a null source is a source; repeated rows and those with equal or null doc_ids are rows of
    their own; an empty table stays empty; other columns go.
    """
    documents, pieces = mixing.mix(docs)
    return mixing.with_text(docs.select(*COLUMNS), documents, pieces)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the token files: null doc_ids first, null and empty texts with the end id alone, repeated rows each; an empty table gives no row."""
    at = token_files.write(docs, f"{shared_dir(spark)}/pipeline-token-ids-{uuid.uuid4().hex}")
    return token_files.index(token_files.read(spark, at))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
