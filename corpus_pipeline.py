"""The pipeline from documents to packed sequences: its stages, its run and its SQL (see routeloom.llm.pipeline)."""

from routeloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
