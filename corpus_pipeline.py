"""Documents to a training mix: language, near copies, repeated passages, benchmark leaks, mixing."""

from weirmesh.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
