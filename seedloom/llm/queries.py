"""The training-data queries (pN_...) and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import batch_history, cross_split, mixing, mojibake, near_groups, packing, personal_info, proportions, similar_sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": batch_history.p1_found,
        "p2_found": near_groups.p2_found,
        "p3_found": cross_split.p3_found,
        "p3_overlap_report": cross_split.p3_overlap_report,
        "p4_found": proportions.p4_found,
        "p4_sample": proportions.p4_sample,
        "p4_shares": proportions.p4_shares,
        "p5_found": personal_info.p5_found,
        "p5_redacted": personal_info.p5_redacted,
        "p6_packing": packing.p6_packing,
        "p6_fill_report": packing.p6_fill_report,
        "p7_mix": mixing.p7_mix,
        "p7_shares": mixing.p7_shares,
        "p8_found": mojibake.p8_found,
        "p8_restored": mojibake.p8_restored,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": similar_sql.P3_FOUND_SQL,
        "p3_overlap_report": similar_sql.P3_OVERLAP_REPORT_SQL,
        "p4_found": proportions.P4_FOUND_SQL,
    }
