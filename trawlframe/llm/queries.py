"""Imports the modules that register queries."""

from trawlframe.llm import (  # noqa: F401
    q_codes, q_copies, q_fingerprints, q_licenses, q_lines, q_neighbours, q_pii, q_quality, q_scores,
    q_tokens, q_urls, q_whitening,
)
from trawlframe.llm.registry import ORACLES, QUERIES  # noqa: F401
