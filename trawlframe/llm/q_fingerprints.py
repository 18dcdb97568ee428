"""Fingerprints of all documents and of their edited texts."""

from __future__ import annotations

from trawlframe.llm.common import table
from trawlframe.llm.registry import query
from trawlframe.llm.syncmers import edited_fingerprints


@query("op1_closed_syncmers")
def op1_closed_syncmers(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))
