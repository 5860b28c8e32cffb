"""The training-data queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from basalt.llm import brown, cascade, decontam, golay, langid, packing, secret_scan, sharding, sitetree, toxicity
from basalt.llm.common import table


def _docs(op):
    return lambda spark, sf_dir: op(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pack_powers_of_two": _docs(packing.op_query),
    "op2_toxicity_deobfuscated": lambda spark, d: toxicity.op_query(table(spark, d, "documents"), table(spark, d, "labels")),
    "op3_shard_hypergeometric": _docs(sharding.op_query),
    "op4_brown_perplexity": _docs(brown.op_query),
    "op5_site_style_tree": lambda spark, d: sitetree.op_query(table(spark, d, "pages")),
    "op6_rank_order_language": _docs(langid.op_query),
    "op7_rule_cascade": _docs(cascade.op_query),
    "op8_template_decontamination": lambda spark, d: decontam.op_query(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op9_secret_forest": _docs(secret_scan.op_query),
    "op10_golay_simhash": _docs(golay.op_query),
}

#: DuckDB twins, where SQL can express the result.
ORACLE_SQL = {"op7_rule_cascade": cascade.SQL, "op8_template_decontamination": decontam.SQL}
