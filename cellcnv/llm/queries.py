"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from .bpe import op8_byte_bpe
from .classifier import op1_quality_classifier
from .jaccard import OP11_SQL, op11_ngram_jaccard
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op9_packing
from .pii import op7_pii
from .rules import op5_quality_rules
from .search import op3_search
from .simhash import op6_simhash
from .suffixes import op4_suffix_dedup
from .templates import OP10_SQL, op10_line_dedup
from .variants import op13_spelling_variants
from .warc import OP2_SQL, op2_warc

QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_warc, op3_search, op4_suffix_dedup, op5_quality_rules, op6_simhash, op7_pii, op8_byte_bpe, op9_packing, op10_line_dedup, op11_ngram_jaccard, op12_hard_negatives, op13_spelling_variants)}
ORACLE_SQL = {"op2_warc": OP2_SQL, "op10_line_dedup": OP10_SQL, "op11_ngram_jaccard": OP11_SQL, "op12_hard_negatives": OP12_SQL}
