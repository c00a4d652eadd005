"""The queries of this subpackage: each takes (spark, folder of the tables) and covers whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, license_scan, line_dedup, lm_score, minhash_forest, mixing, pii, quality_rules, suffix_dedup, token_counts
from .common import ship


def _over(run: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables))

    return query


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": _over(license_scan.query, "documents"),
    "op2_token_counts": _over(token_counts.query, "documents"),
    "op3_quality_rules": _over(quality_rules.query, "documents", "labels"),
    "op4_decontaminate": _over(decontaminate.query, "documents", "benchmark"),
    "op5_lm_score": _over(lm_score.query, "documents"),
    "op6_minhash_forest": _over(minhash_forest.query, "documents"),
    "op7_suffix_dedup": _over(suffix_dedup.query, "documents"),
    "op8_mixing": _over(mixing.query, "documents"),
    "op9_line_dedup": _over(line_dedup.query, "documents"),
    "op10_pii": _over(pii.query, "documents"),
}

#: The columns of three of them that SQL can tell, each of the same run of the operator over the whole table.
for name, module, tables in (("op1_license_scan", license_scan, ["documents"]), ("op3_quality_rules", quality_rules, ["documents", "labels"]), ("op10_pii", pii, ["documents"])):
    QUERIES["base_of_" + name] = _over(lambda *t, module=module: module.query(*t).select(*module.BASE_COLUMNS), *tables)

ORACLE_SQL: dict[str, str] = {
    "op2_token_counts": token_counts.QUERY_SQL,
    "op6_minhash_forest": minhash_forest.QUERY_SQL,
    "op7_suffix_dedup": suffix_dedup.QUERY_SQL,
    "op8_mixing": mixing.QUERY_SQL,
    "op9_line_dedup": line_dedup.QUERY_SQL,
    "base_of_op1_license_scan": license_scan.BASE_SQL,
    "base_of_op3_quality_rules": quality_rules.BASE_SQL,
    "base_of_op10_pii": pii.BASE_SQL,
}
