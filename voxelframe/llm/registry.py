"""Queries of this subpackage and their SQL."""

from voxelframe.llm import align, bpe, exact, html, langid, leaks, lines_crf, mixing, rules, sketch, toxicity, trie


def queries():
    found = (
        html.op1_html_extraction,
        bpe.op2_bpe_roundtrip,
        toxicity.op3_toxicity,
        langid.op4_language_id,
        exact.op5_exact_dedup,
        lines_crf.op6_quality_classifier,
        mixing.op7_mixing,
        sketch.op8_minhash_near_dedup,
        bpe.op9_token_counts,
        rules.op10_quality_rules,
        align.op11_tokenizer_alignment,
        trie.op12_prefix_trie,
        leaks.op13_decontamination,
    )
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op5_exact_dedup": exact.OP5_SQL, "op12_prefix_trie": trie.OP12_SQL, "op13_decontamination": leaks.OP13_SQL}
