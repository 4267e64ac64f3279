"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe import op6_bpe
from .embeddings import OP4_SQL, op4_embedding_near_dedup
from .fingerprints import op8_fingerprints
from .jaccard_join import OP2_SQL, op2_ngram_jaccard_join
from .language import op10_language
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import OP3_SQL, op3_mixing
from .sstable import op7_sstable
from .token_counts import op5_token_counts
from .toxicity import op9_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_mixing": op3_mixing,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_bpe": op6_bpe,
    "op7_sstable": op7_sstable,
    "op8_fingerprints": op8_fingerprints,
    "op9_toxicity": op9_toxicity,
    "op10_language": op10_language,
}
ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op2_ngram_jaccard_join": OP2_SQL, "op3_mixing": OP3_SQL, "op4_embedding_near_dedup": OP4_SQL}
