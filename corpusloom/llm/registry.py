"""The queries of this subpackage by name, and their DuckDB SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.byte_bpe import op4_byte_bpe
from corpusloom.llm.fill_in_middle import OP13_SQL, op13_fill_in_middle
from corpusloom.llm.hilbert_search import op8_hilbert_search
from corpusloom.llm.jaccard_join import op3_jaccard_join
from corpusloom.llm.line_dedup import op7_line_dedup
from corpusloom.llm.media import op9_media_columns
from corpusloom.llm.packing import op10_packing
from corpusloom.llm.periodic_runs import op11_periodic_runs
from corpusloom.llm.pseudonyms import op2_pseudonyms
from corpusloom.llm.quality import op5_quality
from corpusloom.llm.quality_rules import OP12_SQL, op12_quality_rules
from corpusloom.llm.suffix_dedup import op6_suffix_dedup
from corpusloom.llm.toxicity import op1_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_hilbert_search": op8_hilbert_search,
    "op9_media_columns": op9_media_columns,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_quality_rules": op12_quality_rules,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL: dict[str, str] = {"op12_quality_rules": OP12_SQL, "op13_fill_in_middle": OP13_SQL}
