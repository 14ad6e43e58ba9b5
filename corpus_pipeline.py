"""From raw documents to token ids: five stages, each of which works on all that its predecessor kept.

Defined results: a null or empty text is no near copy, holds no benchmark window and no secret, and has no ids; the classifier judges
it by its shape. Of rows that repeat or share a text one stays, that of the smallest doc_id, nulls last. Other columns come through
all stages but the last as they are, whatever their names, apart from n_chars, which follows a redacted text. An empty table gives
no rows; without labels of two grades the classifier accepts everything."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, near, pieces, quality, secrets
from tallyspark.llm.common import apart, stored, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is trained on the labelled ones among them."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows, whole = apart(docs, {"row", *quality.RESULTS}, "text")
    return quality.classify(rows, model).where("accepted").select("row.*" if whole else "*").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that shares four fifths of its five-word shingles."""
    return near.deduplicate(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows make less than a twentieth."""
    rows, whole = apart(docs, {"row", "n_words", "n_hit", "hits", "items", "contaminated"}, "text")
    return decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark")).where("not contaminated").select("row.*" if whole else "*").select(*docs.columns)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark for each secret; n_chars follows the text."""
    out = secrets.redact(docs, repo=["source", "lang"])
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the text's ids, with their number and checksum."""
    import public_tokenizers

    out = pieces.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"), digested=True)
    return out.select("doc_id", "lang", "source", "n_pieces", "ids_crc32", "ids")


STAGES = [("quality", classify), ("near_dedup", deduplicate), ("decontaminate", decontaminated), ("secrets", redacted), ("pieces", tokenised)]
#: The first two stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
