"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import jaccard, licences, lm, mixing, packing, phrases, prefixes, quality, secrets, sharding, substrings, vectors, warc

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_licence_scan": licences.op2_licence_scan,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_shard_tree": sharding.op5_shard_tree,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_near_vectors": vectors.op7_near_vectors,
    "op8_warc_archive": warc.op8_warc_archive,
    "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
    "op10_substring_dedup": substrings.op10_substring_dedup,
    "op11_prefix_trie": prefixes.op11_prefix_trie,
    "op12_lm_scores": lm.op12_lm_scores,
    "op13_collocations": phrases.op13_collocations,
}

SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op3_secret_scan": secrets.OP3_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op7_near_vectors": vectors.OP7_SQL,
    "op8_warc_archive": warc.OP8_SQL,
    "op9_ngram_jaccard": jaccard.OP9_SQL,
    "op10_substring_dedup": substrings.OP10_SQL,
    "op11_prefix_trie": prefixes.OP11_SQL,
    "op13_collocations": phrases.OP13_SQL,
}
