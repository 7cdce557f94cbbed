"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from loomgraph.llm import centroids, chunk_dedup, decontamination, fingerprints, language_id, lexical_search, line_dedup, lm_score, mixing, near_dedup, token_rollup, vector_search, warc
from loomgraph.llm.common import read

QUERIES = {
    "op1_line_dedup": lambda s, d: line_dedup.dedup_report(read(s, d, "documents")),
    "op2_mixing": lambda s, d: mixing.mix_digest(read(s, d, "documents")),
    "op3_lm_score": lambda s, d: lm_score.score(read(s, d, "documents")),
    "op4_token_rollup": lambda s, d: token_rollup.token_report(read(s, d, "documents")),
    "op5_warc_revisits": lambda s, d: warc.archive_report(read(s, d, "pages")),
    "op6_substring_dedup": lambda s, d: chunk_dedup.dedup_report(read(s, d, "documents")),
    "op7_fingerprints": lambda s, d: fingerprints.edited_report(read(s, d, "documents")),
    "op8_language_id": lambda s, d: language_id.identify(read(s, d, "documents")),
    "op9_decontamination": lambda s, d: decontamination.leaks(read(s, d, "documents"), read(s, d, "benchmark")),
    "op10_near_dedup": lambda s, d: near_dedup.near_classes(read(s, d, "documents")),
    "op11_lexical_search": lambda s, d: lexical_search.rank(read(s, d, "documents"), read(s, d, "benchmark")),
    "op12_vector_search": lambda s, d: vector_search.hundredth_search(read(s, d, "embeddings")),
    "op13_centroids": lambda s, d: centroids.cluster_report(read(s, d, "embeddings")),
}

#: What SQL can express; the other queries are tested against plain forms.
ORACLE_SQL = {"op2_mixing": mixing.ORACLE_SQL, "op5_warc_revisits": warc.ORACLE_SQL, "op11_lexical_search": lexical_search.ORACLE_SQL, "op13_centroids": centroids.ORACLE_SQL}
