"""Corpus pipeline: its stages are those of aisleframe.llm.pipeline."""

from aisleframe.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
