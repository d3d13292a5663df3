"""The corpus pipeline, as the driver looks for it: the stages are in varve.llm.pipeline."""

from __future__ import annotations

from varve.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
