"""A corpus pipeline: toxicity, quality, near-duplicates, repeated passages, packing.

run(spark, sf_dir) applies STAGES to the documents; each stage's result is written as Parquet to the shared folder and
reread, so that a lost executor costs no earlier stage; what the stage before wrote is then deleted. Models are fitted on
the labels of the documents that a stage gets. Stages keep rows with null or repeated ids as their operators say; a
repeated row is a copy and one stays. Null and empty texts are judged as empty ones and stay null or empty; long texts go
through whole. Of near-duplicates that tie the smallest id stays. Other columns come back as they were, whatever their
names, but for n_chars, which follows a cut text. Empty documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catchwater.llm import ngram_jaccard, packing, quality, substring_dedup, toxicity
from catchwater.llm.common import dropped, written
from catchwater.llm.queries import table


def _packed(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text in one, out of the way of an operator's own names."""
    return docs.select("doc_id", "text", F.struct(F.lit(None).cast("int").alias("none"), *(c for c in docs.columns if c not in ("doc_id", "text"))).alias("__rest"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c if c in ("doc_id", "text") else f"__rest.`{c}`").alias(c) for c in docs.columns))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _unpacked(model.score(_packed(docs)).where("predicted = 0"), docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _unpacked(model.score(_packed(docs)).where("predicted = 1"), docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id; repeated rows count once."""
    joined = ngram_jaccard.join(docs)
    gone = written(joined.where("doc_id <> class_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"]).select(docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in a document with a smaller id; a text that loses nothing stays as it is."""
    cut = substring_dedup.dedup(_packed(docs))
    lost = F.col("n_removed") > 0
    text, rest = F.when(lost, F.col("kept")).otherwise(F.col("text")), F.col("__rest")
    if "n_chars" in docs.columns:
        rest = rest.withField("n_chars", F.when(lost, F.length("kept").cast("long")).otherwise(F.col("__rest.n_chars")))
    return _unpacked(cut.withColumns({"text": text, "__rest": rest}), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its ids of the tokenizer, its bin, the bin's size and the piece's place there."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL expresses the classifiers or the packing; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)
    return docs
