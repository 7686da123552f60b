"""The training-corpus pipeline of ``ledgerlens.llm.pipeline``: its stages, their SQL and the whole run."""

from ledgerlens.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
