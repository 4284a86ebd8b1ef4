"""The corpus pipeline: its stages and its run, as the driver looks them up. They live in the llm subpackage."""

from galvana.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
