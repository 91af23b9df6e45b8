"""The registered queries of this subpackage and their SQL."""

from tessera.llm import bpe, centroids, decontaminate, filter_audit, line_dedup, minhash, quality_model, quality_rules, secrets, sentence_dedup, sharding, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_toxicity": toxicity.op2,
    "op3_bpe": bpe.op3,
    "op4_sharding": sharding.op4,
    "op5_quality_model": quality_model.op5,
    "op6_minhash_dedup": minhash.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_secret_scans": secrets.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_sentence_dedup": sentence_dedup.op10,
    "op11_centroid_clustering": centroids.op11,
    "op12_filter_audit": filter_audit.op12,
    "op13_line_dedup": line_dedup.op13,
}
ORACLES = {
    "op4_sharding": sharding.OP4_SQL, "op7_quality_rules": quality_rules.OP7_SQL, "op9_decontamination": decontaminate.OP9_SQL,
    "op11_centroid_clustering": centroids.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL, "op13_line_dedup": line_dedup.OP13_SQL,
}
