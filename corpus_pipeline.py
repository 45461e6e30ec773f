"""The corpus pipeline: documents through five operators, each stage's rows written before the next reads them.

Language ID (documents it rejects go), near-duplicates (one document of each group stays), secrets
(spans are cut out), mixing to target weights, byte-level BPE. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.llm import bpe, language, mixing, near_copies, secrets
from plurality.llm.common import discard, materialize, short_batches

#: Least posterior of a language that a document is accepted with: more likely than all others together.
MIN_POSTERIOR = 0.5
#: Bytes of text in a slice and of words in a query of the last stage, half the standard: workers stand beside a JVM that four stages filled.
SLICE, QUERY = 1 << 19, 200_000


def _columns(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Goes: a document whose language cannot be told: null text, no letter in it, or no language more likely than the rest.

    Without a labelled row nothing is learned, and every text with a letter stays. Equal texts fare alike.
    """
    short_batches(spark)
    return _columns(language.accept_language(docs, min_score=MIN_POSTERIOR), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stays: of each group linked by five-word shingle similarity of 0.8 or more, the document with the smallest id.

    SimHash fingerprints of the shingles and their pigeonhole index tie close copies, bands of minimum hashes the others.
    Null text counts as empty, null ids come after all others; of rows that repeat whole one stays.
    """
    return _columns(near_copies.keep_one(docs), docs)


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secret spans read ``[SECRET]``, and ``n_chars`` is counted again. Null texts stay null."""
    out = secrets.redact_secrets(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return _columns(out, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents without a word are not taken, rows that repeat are mixed one by one."""
    return _columns(mixing.mix_documents(docs), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` of every row of the mix."""
    short_batches(spark)
    return bpe.encode(docs, slice_bytes=SLICE, query_bytes=QUERY)


STAGES = [
    ("language ID", identify_language),
    ("near-dedup by shingles", drop_near_duplicates),
    ("secret scans", cut_secrets),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: Byte pair merging and the language model have no form in SQL. tests/llm holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
        discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
