"""The queries of this subpackage, by name. SQL is given where SQL can express an operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridledger.llm.bpe import op6_bpe
from gridledger.llm.fill_middle import OP11_SQL, op11_fill_middle
from gridledger.llm.fingerprints import op13_fingerprints
from gridledger.llm.language_id import op10_language_id
from gridledger.llm.near_vectors import OP4_SQL, op4_near_vectors
from gridledger.llm.neighbours import op3_neighbours
from gridledger.llm.ngram_join import OP1_SQL, op1_ngram_join
from gridledger.llm.packing import op8_packing
from gridledger.llm.private_data import op9_private_data
from gridledger.llm.quality import op5_quality
from gridledger.llm.quotations import op7_quotations
from gridledger.llm.role_repair import OP12_SQL, op12_role_repair
from gridledger.llm.suffix_tree import op2_suffix_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_neighbours": op3_neighbours,
    "op4_near_vectors": op4_near_vectors,
    "op5_quality": op5_quality,
    "op6_bpe": op6_bpe,
    "op7_quotations": op7_quotations,
    "op8_packing": op8_packing,
    "op9_private_data": op9_private_data,
    "op10_language_id": op10_language_id,
    "op11_fill_middle": op11_fill_middle,
    "op12_role_repair": op12_role_repair,
    "op13_fingerprints": op13_fingerprints,
}

ORACLE_SQL: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op4_near_vectors": OP4_SQL, "op11_fill_middle": OP11_SQL, "op12_role_repair": OP12_SQL}
