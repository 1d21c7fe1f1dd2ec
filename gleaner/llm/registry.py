"""Queries of the training-data operators and their oracle SQL."""

import corpus_pipeline
from gleaner.llm import op1_quality_rules as op1
from gleaner.llm import op2_jaccard_join as op2
from gleaner.llm import op3_wavelet as op3
from gleaner.llm import op4_bpe_reuse as op4
from gleaner.llm import op5_topk as op5
from gleaner.llm import op6_warc as op6
from gleaner.llm import op7_toxicity as op7
from gleaner.llm import op8_token_counts as op8
from gleaner.llm import op9_best_fit_packing as op9
from gleaner.llm import op10_quality_classifier as op10

QUERIES = {
    "op1_quality_rules": op1.op1_quality_rules,
    "op2_jaccard_join": op2.op2_jaccard_join,
    "op3_wavelet_shards": op3.op3_wavelet_shards,
    "op4_bpe_chunk_reuse": op4.op4_bpe_chunk_reuse,
    "op5_exact_topk": op5.op5_exact_topk,
    "op6_warc_revisits": op6.op6_warc_revisits,
    "op7_toxicity": op7.op7_toxicity,
    "op8_token_counts": op8.op8_token_counts,
    "op9_best_fit_packing": op9.op9_best_fit_packing,
    "op10_quality_classifier": op10.op10_quality_classifier,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op1_quality_rules": op1.SQL,
    "op5_exact_topk": op5.SQL,
    "op6_warc_revisits": op6.SQL,
    "op10_quality_classifier": op10.SQL,
}
