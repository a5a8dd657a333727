"""A training corpus from raw documents, in five stages; see ``cellweave.llm.pipeline``."""

from cellweave.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
