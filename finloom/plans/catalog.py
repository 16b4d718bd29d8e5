"""All queries of the library but those of the corpus operators, with their SQL."""

from __future__ import annotations

from . import basic, documents, domain, silver, summaries, upkeep

FLAGSHIP = "quality_scores"

QUERIES = basic.QUERIES | domain.QUERIES | summaries.QUERIES | upkeep.QUERIES | documents.QUERIES | silver.QUERIES
ORACLES = basic.ORACLES | domain.ORACLES | summaries.ORACLES | upkeep.ORACLES | documents.ORACLES | silver.ORACLES
