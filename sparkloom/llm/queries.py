"""Registered queries of this subpackage and the SQL that gives the same rows where there is such SQL."""

from . import bpe, copies, jaccard, langid, licenses, mixing, pii, repeats, sharding, spelling, vectors, whitening

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_shard_documents": sharding.op3_shard_documents,
    "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
    "op5_bpe_round_trip": bpe.op5_bpe_round_trip,
    "op6_embedding_near_dups": vectors.op6_embedding_near_dups,
    "op7_nearest_neighbours": vectors.op7_nearest_neighbours,
    "op8_repeat_removal": repeats.op8_repeat_removal,
    "op9_pii_surrogates": pii.op9_pii_surrogates,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_exact_dedup": copies.op11_exact_dedup,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}

ORACLES = {"op2_license_scan": licenses.OP2_SQL, "op10_mix_sources": mixing.OP10_SQL, "op11_exact_dedup": copies.OP11_SQL}
