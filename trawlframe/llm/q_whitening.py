"""All embeddings, whitened."""

from __future__ import annotations

from trawlframe.llm.common import table
from trawlframe.llm.registry import query
from trawlframe.llm.whitening import whitened_components


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    return whitened_components(table(spark, sf_dir, "embeddings"))
