"""The corpus pipeline: toxicity, near copies, repeated passages, personal data, packing.

All stages but the last give the columns of their input; columns besides doc_id, text and n_chars pass through whatever
their names are.  Empty tables stay empty, null texts stay null, repeated rows are rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqtally.llm.common import scratch, table
from seqtally.llm.packing import pack
from seqtally.llm.passages import remove_repeats
from seqtally.llm.pii import find_personal_data
from seqtally.llm.simhash import near_duplicates
from seqtally.llm.toxicity import score, train


#: Near copies: words of a shingle, bits in which fingerprints of those compared first may differ, Jaccard similarity at least.
SHINGLE, BITS, SIMILARITY = 5, 3, 0.8


#: Rows and bytes of a batch that goes to a Python worker, at most: a document has some thousand bytes, and a long one much more.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"


def _small_batches(spark: SparkSession) -> None:
    """From here on the session's batches are small, so that a task's buffers on either side of a worker's pipe are."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "0")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more go.  The model is fitted on the labelled rows of ``docs``; empty and null texts score its bias."""
    _small_batches(spark)
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(_hidden(docs), model).filter("predicted = 0")
    return scored.select(*_shown(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Near copies are connected by texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: all such, exactly.
    SimHash fingerprints unite most of them, and a prefix filter over all sets finds the others.  Texts of fewer words are one shingle; those
    without words, null ones too, are copies of each other.  Documents with a null id, which can't be told apart, stay.
    """
    _small_batches(spark)
    groups = near_duplicates(docs, shingle=SHINGLE, distance=BITS, least=SIMILARITY)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 13 words or more that an earlier document has are cut out; other texts, null and empty ones too, stay as they are.

    Of documents with equal ids none counts as earlier, and a null id is later than any other.
    """
    _small_batches(spark)
    out = remove_repeats(_hidden(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.select(*_shown(docs, text))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in angle brackets; a null text stays null and an empty one empty."""
    _small_batches(spark)
    return find_personal_data(_hidden(docs), masked=True).select(*_shown(docs, F.col("masked_text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; a null or empty text is its end id alone, repeated rows are packed each."""
    _small_batches(spark)
    return pack(docs)


def _names(docs: DataFrame) -> dict[str, str]:
    return {c: c if c in ("doc_id", "text") else f"_column_{i}" for i, c in enumerate(docs.columns)}


def _hidden(docs: DataFrame) -> DataFrame:
    """docs with other columns under private names, so that none of them is taken for a column of an operator."""
    return docs.select(*(F.col(f"`{c}`").alias(new) for c, new in _names(docs).items()))


def _shown(docs: DataFrame, text: Column | None = None) -> list[Column]:
    """The columns of docs out of a result of ``_hidden``, with a new text and its length if one is given."""
    out = {c: F.col(new).alias(c) for c, new in _names(docs).items()}
    if text is not None:
        out["text"] = text.alias("text")
        if "n_chars" in out:
            out["n_chars"] = F.char_length(text).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return list(out.values())


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("passages", passages), ("personal_data", personal_data), ("packing", packing)]

#: A trained model, a similarity search, hashes of tokens: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
