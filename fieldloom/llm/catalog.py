"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

import corpus_pipeline
from fieldloom.llm.chat import OP7_SQL, op7_chat
from fieldloom.llm.licenses import op10_licenses
from fieldloom.llm.minhash import OP9_SQL, op9_minhash
from fieldloom.llm.mixing import op4_mixing
from fieldloom.llm.nn_descent import OP3_SQL, op3_nn_descent
from fieldloom.llm.packing import op1_packing
from fieldloom.llm.posting_lists import op2_posting_lists
from fieldloom.llm.quality import op6_quality
from fieldloom.llm.secrets import op8_secrets
from fieldloom.llm.suffix_tree import op5_suffix_tree


def queries():
    return {f.__name__: f for f in (op1_packing, op2_posting_lists, op3_nn_descent, op4_mixing, op5_suffix_tree, op6_quality, op7_chat, op8_secrets, op9_minhash, op10_licenses)} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op3_nn_descent": OP3_SQL, "op7_chat": OP7_SQL, "op9_minhash": OP9_SQL}
