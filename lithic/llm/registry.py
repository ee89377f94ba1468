"""The queries of this package and their SQL twins."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, exact_dedup, langid, line_dedup, near_dedup, packing, quality, sharding, url_filter


def queries() -> dict:
    return {
        "op1_pu_quality": quality.op1,
        "op2_exact_dedup": exact_dedup.op2,
        "op3_byte_bpe": bpe.op3,
        "op4_adaptive_scan": ann.op4,
        "op5_line_dedup": line_dedup.op5,
        "op6_hyperminhash": near_dedup.op6,
        "op7_histogram_shards": sharding.op7,
        "op8_url_templates": url_filter.op8,
        "op9_centroid_language": langid.op9,
        "op10_best_fit_packing": packing.op10,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op5_line_dedup": line_dedup.ORACLE_SQL, "op8_url_templates": url_filter.oracle_sql()}
