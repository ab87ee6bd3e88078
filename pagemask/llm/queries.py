"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pagemask.llm.bpe import op7_bpe
from pagemask.llm.decontaminate import op10_decontaminate
from pagemask.llm.dialogues import OP5_SQL, op5_dialogues
from pagemask.llm.periodic_runs import op11_periodic_runs
from pagemask.llm.pii import op1_pii
from pagemask.llm.quality import OP2_SQL, op2_quality
from pagemask.llm.secrets import op3_secrets
from pagemask.llm.simhash import op6_simhash
from pagemask.llm.sketches import op12_fingerprints
from pagemask.llm.substrings import op4_substrings
from pagemask.llm.token_counts import op9_token_counts
from pagemask.llm.token_files import op8_token_files
from pagemask.llm.whitening import op13_whitening

QUERIES = {
    "op1_pii": op1_pii,
    "op2_quality": op2_quality,
    "op3_secrets": op3_secrets,
    "op4_substrings": op4_substrings,
    "op5_dialogues": op5_dialogues,
    "op6_simhash": op6_simhash,
    "op7_bpe": op7_bpe,
    "op8_token_files": op8_token_files,
    "op9_token_counts": op9_token_counts,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fingerprints": op12_fingerprints,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {"op2_quality": OP2_SQL, "op5_dialogues": OP5_SQL}
