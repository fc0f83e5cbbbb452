"""All queries of this package by name, the pipeline included."""

from __future__ import annotations

import corpus_pipeline
from riskweave.llm.queries import ORACLE, QUERIES


def llm_queries() -> dict:
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def llm_oracles() -> dict[str, str]:
    more = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
    return {**ORACLE, **more}
