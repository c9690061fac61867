"""From raw documents to token ids: five stages, each an operator of ``auxograph.llm``.

Every stage takes what its predecessor kept, written as Parquet and read again:

1. quality: documents that the weak-label classifier rejects go;
2. near_dedup: one document of each group of near-duplicates stays;
3. decontamination: documents contaminated by the benchmark go;
4. mixing: sources are cut or repeated to their target weights;
5. token_store: the mix is encoded, written as ORC and read back, a row per stored document.

All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auxograph.llm import decontamination, mixing, near_dedup, quality, token_store
from auxograph.llm.shared import Scratch, scratch_deleted


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose score is at least the classifier's least score.

    Null, empty and blank texts show no sign of junk and are scored like any text; a very long text is
    scored as a whole; repeated rows get equal scores, so all of them stay or go; null identifiers are
    scored like others. Columns of any other name pass through unread, also ``score`` and ``kept``. An
    empty table stays empty.
    """
    return quality.clean_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest identifier of each group of near-duplicates.

    Texts without words are linked with nothing and stay, repeated or not; of repeated rows with words
    one stays; null identifiers come after all others; very long texts are compared as wholes. Other
    columns pass through unread. An empty table stays empty.
    """
    return near_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which at least a twentieth is text of the benchmark.

    Texts without words stay; a very long text is judged by the share of all its words; repeated rows
    and rows without an identifier are judged by their text. Columns that ``documents`` and
    ``benchmark`` have in common do not meet. An empty table stays empty, and an empty benchmark
    drops nothing.
    """
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut or repeat each source to its target.

    A null source is a source. Texts without words have no size and do not come. Rows that agree in
    identifier and text are given as much as the mix takes of them together; a very long text may be
    cut in the middle, at words. Other columns are repeated with their row. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def token_store_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode, write, and read back: doc_id, start, n_tokens, ids_crc32.

    One row per row of the mix, so a document that comes several times is stored as often. A null or
    empty text is the end id alone; null identifiers come last; a very long text is one row. Other
    columns are not read. An empty table gives an empty store.
    """
    import public_tokenizers

    path = Scratch(spark, "pipeline-tokens").path("store")
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.token_offsets(spark, path)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_store", token_store_stage),
]

#: Neither the classifier nor the tokenizer can be expressed in SQL; the tests have a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what a stage leaves behind goes once its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch_deleted():
            docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
