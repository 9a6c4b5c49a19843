"""Corpus pipeline: documents to packed training sequences.

STAGES run in order, each over all that its predecessor kept; every result is written as
Parquet and read again before the next stage:

* language_id: documents whose language cannot be told (no letters) go, and those of
  which too few n-grams belong to the language found (`MIN_SCORE`);
* jaccard_join: of documents with 5-word shingle similarity of 0.8 or more, directly or
  through others, the one with the smallest id stays (NULL ids after all others, ties by
  text);
* decontamination: documents that leak a benchmark item go;
* secret_scan: secrets are replaced in the text, n_chars follows;
* best_fit_packing: the rest is packed into sequences of 1024 tokens.

All but the last return the columns of documents, extra ones included. NULL texts go with
the first stage; NULL and repeated ids are grouped by text like any other; an empty table
passes through. Of a group one row stays. Columns of any name keep their values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontam, jaccard, langid, packing, secrets
from tallymark.llm.common import neutral, restored, table, written
from tallymark.llm.queries import tokenizer_path

MIN_SCORE = 0.2
SHINGLE, PERCENT = 5, 80

#: Stages train models and join groups; SQL cannot express them.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Filters learned from all labelled documents at hand."""
    model = langid.train(docs)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    judged = langid.predict(marked, model).filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= MIN_SCORE))
    return judged.select("doc.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = neutral(docs)
    doc_id, text = names["doc_id"], names["text"]
    groups = jaccard.similar_documents(plain, SHINGLE, PERCENT, doc_id, text)
    # The first of a group; rows are known by id and text. Documents without words are
    # linked with nothing.
    alone = F.when(F.col("label").isNull(), F.struct("doc_id", "row"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    heads = groups.groupBy("label", alone.alias("alone")).agg(first.alias("head"))
    heads = written(heads.select(F.col("head.doc_id").alias("head_id"), F.col("head.row").alias("head_row")), "heads")
    keyed = plain.withColumn("key", F.xxhash64(text))
    same = keyed[doc_id].eqNullSafe(heads["head_id"]) & keyed["key"].eqNullSafe(heads["head_row"])
    kept = keyed.join(heads, same, "left_semi")
    return kept.dropDuplicates([doc_id, "key"]).select(*restored(names))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = neutral(docs)
    marked = decontam.mark(plain, table(spark, sf_dir, "benchmark"), names["text"])
    return marked.filter("n_leaks = 0").select(*restored(names))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, names = neutral(docs)
    text = names["text"]
    clean = secrets.redact(secrets.scan(plain, names["doc_id"], text), text)
    if "n_chars" in names:
        size = names["n_chars"]
        length = F.length(text).cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn(size, F.when(F.size("secrets") > 0, length).otherwise(F.col(size)))
    return clean.select(*restored(names))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
