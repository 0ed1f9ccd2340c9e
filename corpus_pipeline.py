"""From raw documents to training tokens: each stage works on the whole of what the one before it kept.

Defined results of the stages, whatever the documents' other columns are called (all of them pass through every stage but the
last, with their types): a null or empty text is neither toxic nor a copy nor contaminated, and has no ids; rows with a null id
are kept by the second stage and lose no passage in the third; of rows that repeat an id the second stage keeps one; of documents
that are linked the smallest id stays; texts of any length are worked on as a whole; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.llm import bpe, decontaminate, near_dedup, substring_dedup, toxicity
from pagequarry.llm.common import Scratch, nested, table


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in one struct, where no operator's column can clash with them."""
    own, _ = nested(docs, ["doc_id", "text"])
    return docs.select("doc_id", "text", own.alias("own"))


def _together(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of ``docs`` again, some of them changed."""
    columns = [changed.get(c, F.col(c) if c in ("doc_id", "text") else F.col("own").getField(c)).alias(c) for c in docs.columns]
    return df.select(*columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches one half go; the model learns from the labelled rows among ``docs``."""
    model = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"))
    return _together(toxicity.score_toxicity(_apart(docs), model).where("toxicity < 0.5"), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 or more over five-word shingles, that with the smallest id stays."""
    return _together(near_dedup.keep_one(_apart(docs), shingle=5, percent=80), docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has leave the text; n_chars follows the text where it is cut."""
    cut = substring_dedup.substring_dedup(_apart(docs))
    changed = {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        length = F.length("clean_text").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(F.col("n_removed") > 0, length).otherwise(F.col("own").getField("n_chars"))
    return _together(cut, docs, **changed)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return _together(decontaminate.decontaminate(_apart(docs), table(spark, sf_dir, "benchmark")).where("n_hit = 0"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether decoding the ids gives the text's bytes again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.bpe_encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.bpe_decode(encoded, ranks, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", remove_toxic),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", remove_contaminated),
    ("byte_level_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over the tables that the others have written; ``common.clean_up`` removes these once its rows are stored."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity model and the merges of BPE can't be told in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None
