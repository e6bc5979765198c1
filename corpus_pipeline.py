"""Corpus pipeline: reject toxic texts, drop repeated lines, near duplicates and benchmark leaks, then tokenise.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and, but for the
last, returns the columns of ``documents``; ``run`` writes each stage as Parquet and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kurvex.llm.bpe import bpe_encode_decode
from kurvex.llm.decontaminate import contaminated
from kurvex.llm.line_dedup import line_dedup
from kurvex.llm.ngram_jaccard import ngram_jaccard_join
from kurvex.llm.queries import vocabulary
from kurvex.llm.runtime import drop, restrict, store
from kurvex.llm.toxicity import fit_toxicity, labelled_sample, score_toxicity


def _row(docs: DataFrame):
    """The columns of ``docs`` as one struct, so that none can clash with an operator's own."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the model is fitted on the labelled ones.

    Null, empty and blank texts score as texts without hits; repeated rows share their fate; rows without a doc_id are
    scored, but have no label.  Other columns stay, whatever their names; an empty table gives no rows.
    """
    model = fit_toxicity(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    scored = score_toxicity(docs.select(_row(docs), "text"), model, ["row"])
    return scored.where("score < 0.5").select("row.*")


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that come earlier; a document of which no word is left goes, and n_chars follows the text.

    Documents that lose nothing stay as they are, those with a null or blank text and rows without a doc_id too.
    Of equal or near lines the first in the order (doc_id, line) stays.  Other columns stay, whatever their names.
    """
    out = line_dedup(docs.select("doc_id", "text", _row(docs.drop("text"))), exact_words=1).where("n_removed = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    chars = F.when(F.col("n_removed") > 0, F.length("text"))
    fresh = {"text": F.col("text"), "n_chars": F.coalesce(chars.cast(dict(docs.dtypes).get("n_chars", "long")), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*((fresh[c] if c in fresh else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each component of n-gram Jaccard links.

    Rows of one doc_id are one document, of which the row with the least text stays.  Null, empty and blank texts and rows
    without a doc_id link with nothing and stay.  Other columns stay, whatever their names.
    """
    others = store(ngram_jaccard_join(docs).where("doc_id <> component_id").select("doc_id"), "others")
    left = restrict(docs, others, "doc_id", "left_anti").select(*docs.columns)
    again = store(left.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id"), "again")
    if again.isEmpty():
        return left
    first = restrict(left, again, "doc_id").groupBy("doc_id").agg(F.min_by(_row(docs), F.coalesce("text", F.lit(""))).alias("row"))
    return restrict(left, again, "doc_id", "left_anti").select(*docs.columns).union(first.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; null and blank texts and rows without a doc_id stay."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return restrict(docs, store(found.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded text; null texts have no tokens."""
    out = bpe_encode_decode(docs, vocabulary())
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", tokens),
]

#: The model, the exact joins on whole shingle sets and the tokenizer can't be said in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the table of a stage is deleted when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, store(stage(spark, docs, sf_dir), name)
        drop(before)
    return docs
