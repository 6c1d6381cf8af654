"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .bpe_codec import op9_bpe_codec
from .chat_format import OP7_SQL, op7_chat_format
from .embedding_dedup import OP4_SQL, op4_embedding_dedup
from .language_id import op6_language_id
from .line_dedup import OP5_SQL, op5_line_dedup
from .minhash_dedup import OP8_SQL, op8_minhash_dedup
from .mixing import op2_mixing
from .quality_rules import op3_quality_rules
from .token_counts import op1_token_counts
from .toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_mixing,
        op3_quality_rules,
        op4_embedding_dedup,
        op5_line_dedup,
        op6_language_id,
        op7_chat_format,
        op8_minhash_dedup,
        op9_bpe_codec,
        op10_toxicity,
    )
}

ORACLE_SQL = {"op4_embedding_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op7_chat_format": OP7_SQL, "op8_minhash_dedup": OP8_SQL}
