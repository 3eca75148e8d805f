"""The corpus pipeline's stages, as its drivers look for them here; see weft.llm.pipeline."""

from weft.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
