"""The corpus pipeline: its stages and ``run`` are in ``chronofold.llm.pipeline``."""

from chronofold.llm.pipeline import (COLUMNS, ORACLE_SQL, STAGES, drop_near_copies, keep_known_languages, mix_sources, pack_sequences, redact_personal_data, run,
                                     simhash)

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "drop_near_copies", "keep_known_languages", "mix_sources", "pack_sequences", "redact_personal_data", "run", "simhash"]
