"""The queries of this package, by the names under which they are registered."""

from . import alignment, fingerprints, lexical, line_dedup, near_dup, neighbours, packing, quality, quality_rules, sentencepieces, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_neighbours": neighbours.op1_neighbours,
    "op2_quality": quality.op2_quality,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_warc": warc.op4_warc,
    "op5_packing": packing.op5_packing,
    "op6_sentencepiece": sentencepieces.op6_sentencepiece,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_near_duplicates": near_dup.op8_near_duplicates,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_search": lexical.op11_search,
    "op12_alignment": alignment.op12_alignment,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": warc.oracle(),
    "op11_search": lexical.oracle(),
    "op13_quality_rules": quality_rules.oracle(),
}
