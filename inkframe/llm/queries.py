"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from inkframe.llm.decontaminate import op8_decontaminate
from inkframe.llm.embedding_dedup import op4_embedding_dedup
from inkframe.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from inkframe.llm.filter_audit import OP13_SQL, op13_filter_audit
from inkframe.llm.language_id import op9_language_id
from inkframe.llm.ngram_join import OP3_SQL, op3_ngram_join
from inkframe.llm.secret_scan import op5_secret_scan
from inkframe.llm.source_mix import op1_source_mix
from inkframe.llm.token_binary import op2_token_binary
from inkframe.llm.token_counts import op7_token_counts
from inkframe.llm.toxicity import op6_toxicity
from inkframe.llm.warc import op10_warc
from inkframe.llm.whitening import op12_embedding_whitening

QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_token_binary": op2_token_binary,
    "op3_ngram_join": op3_ngram_join,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_token_counts": op7_token_counts,
    "op8_decontaminate": op8_decontaminate,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE_SQL = {"op3_ngram_join": OP3_SQL, "op11_exact_dedup": OP11_SQL, "op13_filter_audit": OP13_SQL}
