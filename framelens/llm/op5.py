"""Query op5: token table of all documents, written and read back."""

from __future__ import annotations

from framelens.llm import common, token_store
from framelens.llm.registry import query


@query("op5_token_store")
def op5_token_store(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    return token_store.checksums(token_store.stored_tokens(docs))
