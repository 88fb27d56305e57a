"""The corpus pipeline: five training-data operators, each on all that the one before it kept."""

from __future__ import annotations

from tidecast.llm import bpe, decontaminate, langid, linededup, neardup
from tidecast.llm.common import materialize, table


def encode(spark, docs, sf_dir):
    """Last stage: every document with its tokens' number and digests and its token ids."""
    return bpe.bpe(docs.select("doc_id", "text"), with_ids=True, with_decoded=False).drop("text")


STAGES = [
    ("language_id", langid.keep_known_language),
    ("line_dedup", linededup.drop_repeated_lines),
    ("near_dedup", neardup.keep_one_of_each),
    ("decontamination", decontaminate.drop_contaminated),
    ("bpe", encode),
]

#: The first stage is a trained network: SQL can't express it.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
