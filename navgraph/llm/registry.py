"""The queries of the numbered operators, and their SQL where SQL can express them."""

from __future__ import annotations

from navgraph.llm.decontam import OP4_SQL, op4_decontaminate
from navgraph.llm.fill_middle import OP13_SQL, op13_fill_middle
from navgraph.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from navgraph.llm.lm_scoring import op6_lm_scoring
from navgraph.llm.mixing import OP9_SQL, op9_mix
from navgraph.llm.near_dedup import op2_near_dedup
from navgraph.llm.packing import op12_packing
from navgraph.llm.quality import op3_quality
from navgraph.llm.secrets import OP8_SQL, op8_secrets
from navgraph.llm.sharding import op10_shard
from navgraph.llm.suffix_dedup import op5_suffix_dedup
from navgraph.llm.token_counts import op7_token_counts
from navgraph.llm.toxicity import op1_toxicity


def queries() -> dict:
    return {"op1_toxicity": op1_toxicity, "op2_near_dedup": op2_near_dedup, "op3_quality": op3_quality, "op4_decontaminate": op4_decontaminate, "op5_suffix_dedup": op5_suffix_dedup, "op6_lm_scoring": op6_lm_scoring, "op7_token_counts": op7_token_counts, "op8_secrets": op8_secrets, "op9_mix": op9_mix, "op10_shard": op10_shard, "op11_hard_negatives": op11_hard_negatives, "op12_packing": op12_packing, "op13_fill_middle": op13_fill_middle}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op8_secrets": OP8_SQL, "op9_mix": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op13_fill_middle": OP13_SQL}
