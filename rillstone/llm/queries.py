"""Queries of this subpackage and their DuckDB equivalents, for the entry point."""

from . import brown_lm, embedding_dedup, gif_media, license_scan, line_dedup, minmax_dedup, mixing, secret_scan, toxicity, unigram

QUERIES = {
    "op1_minmax_dedup": minmax_dedup.op1_minmax_dedup,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_brown_lm": brown_lm.op3_brown_lm,
    "op4_sentencepiece": unigram.op4_sentencepiece,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_gif_media": gif_media.op8_gif_media,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_source_mixing": mixing.op10_source_mixing,
    "media_payload": gif_media.media_payload,
    "lm_base": brown_lm.lm_base,
    "toxicity_rows": toxicity.toxicity_rows,
}

ORACLE_SQL = {
    "op1_minmax_dedup": minmax_dedup.ORACLE,
    "op7_embedding_dedup": embedding_dedup.ORACLE,
    "op10_source_mixing": mixing.ORACLE,
    "media_payload": gif_media.PAYLOAD_ORACLE,
    "lm_base": brown_lm.BASE_ORACLE,
    "toxicity_rows": toxicity.ROWS_ORACLE,
}
