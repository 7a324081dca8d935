"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, clusters, codes, decontaminate, jaccard_join, language, licenses, pieces, quality, repeats, secrets, token_counts, top_k

QUERIES = {
    "op1_repeats": repeats.op1_repeats,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_chat_format": chat.op4_chat_format,
    "op5_top_k": top_k.op5_top_k,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_language_id": language.op8_language_id,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_centroid_clusters": clusters.op12_centroid_clusters,
    "op13_quality": quality.op13_quality,
}

ORACLE_SQL: dict[str, str] = {"op4_chat_format": chat.OP4_SQL, "op5_top_k": top_k.OP5_SQL, "op6_decontaminate": decontaminate.OP6_SQL, "op11_vector_codes": codes.OP11_SQL, "op12_centroid_clusters": clusters.OP12_SQL}
