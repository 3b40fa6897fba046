"""The corpus pipeline: language ID, near-duplicates, decontamination, piece encoding.

Each stage reads what the one before kept, whole, and its decision is final: documents without a language go, one document
of each group of near copies stays, contaminated documents go, and the rest is encoded. Stages return the columns of
documents, but for the last. Between stages the rows are written to the shared folder and read back. Every stage reads texts
of any length whole, keeps null ids, gives an empty table for an empty one, and keeps further columns of documents as they
are, whatever their names, but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, pieces, simhash
from tessera.llm.decontaminate import decontaminated
from tessera.llm.queries import vocabulary
from tessera.llm.shared import small_batches, staged, table, unused


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those that language ID calls ``und`` (null texts and texts without a letter) go.

    Rows that repeat stay; where no document has a label, all go, as no language is known.
    """
    model = langid.learned(docs, ~langid.held_out())
    own = unused(docs, "lang_")
    return langid.identified(docs, model, own).where(F.col(f"{own}lang_pred") != "und").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, a similarity of 0.8 or more): that with the smallest id, null last."""
    return simhash.deduplicated(docs, least=0.8, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves: those without words, and all where there are no items, are clean."""
    own = unused(docs, "scan_")
    out = decontaminated(docs, table(spark, sf_dir, "benchmark"), prefix=own)
    return out.where(~F.col(f"{own}contaminated")).select(*[f"`{c}`" for c in docs.columns])


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids: null for a null text (which no stage before leaves), none for an empty one."""
    out = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"))
    with small_batches(spark):  # whole texts and their ids are held by Python workers
        return staged(out.select("doc_id", "lang", "source", "pieces.n_pieces", "pieces.ids"), "encoding")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("encoding", encoding)]
#: No stage but decontamination can be expressed in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = staged(docs, name) if k + 1 < len(STAGES) else docs
    return docs
