"""Corpus cleaning in five stages over documents, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet
in the shared folder and reads it again as the next one's documents. All stages but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontam, jaccard, langid, packing, secrets
from quire.llm.common import fresh, held_out, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is found: those without text or without a letter go.

    lang becomes the prediction; the network learns from the labelled rows of its input."""
    pred, score = fresh(docs, "pred", "score")
    net = langid.train(docs, learn=~held_out("doc_id", 4))
    found = langid.identify(docs, net, pred=pred, score=score)
    if net is None:  # nothing to learn from, nothing to reject by
        return docs
    return found.where(F.col(pred) != langid.UNKNOWN).withColumn("lang", F.col(pred)).select(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each component of near duplicates (5-word shingles, 80 %).

    Documents without words are linked with nothing and stay. Rows are told apart by id and text: of rows that repeat both
    one stays; different texts under one id, or without one, are each judged by their own words."""
    return jaccard.firsts(docs, settings=jaccard.Settings(n=5, percent=80))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item, edited or whole, with or without an id; documents without text stay."""
    a, b = fresh(docs, "a", "b")
    # a document is its text: equal texts hold the same items
    keyed = docs.withColumn(a, F.xxhash64("text")).withColumn(b, F.xxhash64("text", F.lit(1)))
    hit = decontam.contaminated(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=(a, b))
    return keyed.join(stored(hit.select(a, b).distinct(), "contaminated"), [a, b], "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; n_chars follows. All documents stay; a null text stays null."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most 2048 tokens; a null text is the end token alone."""
    import public_tokenizers

    out = packing.pack_documents(docs.select("doc_id", "text"), str(public_tokenizers.path("word_bpe_49k.json")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: The network and the tokenizer cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
