"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm.decontaminate import OP10_SQL, op10_decontaminate
from tallyward.llm.fill_middle import op11_fill_middle
from tallyward.llm.html import op6_html
from tallyward.llm.line_rules import op13_quality_rules
from tallyward.llm.neardup import op4_neardup
from tallyward.llm.packing import op1_packing
from tallyward.llm.pii import op2_pii
from tallyward.llm.quality import op3_quality
from tallyward.llm.quotes import OP7_SQL, op7_quotes
from tallyward.llm.repair import op12_repair
from tallyward.llm.resharding import op9_resharding
from tallyward.llm.syncmers import op5_syncmers
from tallyward.llm.toxicity import op8_toxicity


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_pii": op2_pii,
        "op3_quality": op3_quality,
        "op4_neardup": op4_neardup,
        "op5_syncmers": op5_syncmers,
        "op6_html": op6_html,
        "op7_quotes": op7_quotes,
        "op8_toxicity": op8_toxicity,
        "op9_resharding": op9_resharding,
        "op10_decontaminate": op10_decontaminate,
        "op11_fill_middle": op11_fill_middle,
        "op12_repair": op12_repair,
        "op13_quality_rules": op13_quality_rules,
    }


def llm_oracles() -> dict[str, str]:
    return {"op7_quotes": OP7_SQL, "op10_decontaminate": OP10_SQL}
