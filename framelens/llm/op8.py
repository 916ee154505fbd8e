"""Query op8: byte-level BPE of all documents, and back."""

from __future__ import annotations

from framelens.llm import byte_bpe, common
from framelens.llm.registry import query


@query("op8_byte_bpe")
def op8_byte_bpe(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return byte_bpe.round_trip(docs)
