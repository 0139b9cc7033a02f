"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""


def queries():
    from . import binary_output, brown_lm, decontaminate, language_id, media, mixing, near_dedup, quality_rules, resampling, secrets, token_counts, url_filter, whitening

    return {
        "op1_brown_lm": brown_lm.op1_brown_lm,
        "op2_secret_scan": secrets.op2_secret_scan,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_edit_aware_counts": token_counts.op4_edit_aware_counts,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_binary_output": binary_output.op6_binary_output,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_near_dedup": near_dedup.op8_near_dedup,
        "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
        "op10_language_id": language_id.op10_language_id,
        "op11_importance_resampling": resampling.op11_importance_resampling,
        "op12_embedding_whitening": whitening.op12_embedding_whitening,
        "op13_media_chunks": media.op13_media_chunks,
    }


def oracle_sql():
    from . import near_dedup, quality_rules

    return {"op7_quality_rules": quality_rules.OP7_SQL, "op8_near_dedup": near_dedup.OP8_SQL}
