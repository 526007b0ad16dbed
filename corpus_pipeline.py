"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm import op3_bpe, op4_suffix, op7_simhash, op8_decontam, op9_langid, repeats
from weftline.session import scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A prediction below this posterior is no language.
CERTAIN = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: null texts, texts without letters, uncertain predictions."""
    model = op9_langid.fit(spark, docs)
    found = op9_langid.predict(spark, docs.select(*COLUMNS), model)
    return found.filter((F.col("lang_pred") != op9_langid.UND) & (F.col("score") >= CERTAIN)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component one row, of its smallest id. Texts link at a similarity of 0.8, the cosine of their sets of five-word shingles, which is what SimHash measures."""
    found = op7_simhash.near_copies(spark, docs, k=5, similarity=0.8)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first")
    keep = found.groupBy("cluster").agg(first).select("first.row_key")
    kept = docs.select(*COLUMNS).withColumn("row_key", repeats.row_key()).join(keep, "row_key", "left_semi")
    again = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    return kept.withColumn("again", again).filter("again = 1").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every byte of a 100-byte string that also starts earlier; what is left of a character at a cut goes with it. Texts of which nothing is left go."""
    found = op4_suffix.dedup(spark, docs, carry=("lang", "source", "n_chars"), whole=True)
    extra = F.from_json("extra", "lang string, source string, n_chars long")
    left = found.filter("n_removed = 0 or n_removed < n_bytes").select("doc_id", F.col("kept").cast("string").alias("text"), extra.alias("extra"))
    return left.select("doc_id", "text", "extra.lang", "extra.source", F.length("text").cast("long").alias("n_chars")).filter("length(trim(text)) > 0")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with an occurrence of a window of a benchmark item."""
    found = op8_decontam.find(spark, docs, table(spark, sf_dir, "benchmark"), carry=tuple(COLUMNS[1:]))
    return found.filter(F.size("items") == 0).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, the digest of the decoded text proving the round trip."""
    return op3_bpe.encode(spark, docs).drop("decoded")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokens),
]

#: Naive Bayes, fingerprints and BPE have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        at = scratch(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return STAGES[-1][1](spark, docs, sf_dir)
