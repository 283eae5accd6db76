"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewright.llm import audio, html_text, language_id, mixing, near_dup, packing, suffix_dedup, topk, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_noisy_or_toxicity": toxicity.query,
        "op2_pivotal_mixing": mixing.query,
        "op3_block_topk": topk.query,
        "op4_cover_suffix_dedup": suffix_dedup.query,
        "op5_audio_features": audio.query,
        "op6_host_suffix_text": html_text.query,
        "op7_length_buckets": packing.query,
        "op8_url_filter": url_filter.query,
        "op9_gru_language": language_id.query,
        "op10_superminhash_groups": near_dup.query,
        "pipeline": pipeline,
    }


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracles() -> dict:
    return {"op3_block_topk": topk.SQL, "op8_url_filter": url_filter.SQL, "op10_superminhash_groups": near_dup.SQL}
