"""Column functions of all operator modules in one place."""

from lexiloom.operators.blocks import fingerprint, fingerprint_v2, standard_clean
from lexiloom.operators.chunks import common_prefix, embedding_text
from lexiloom.operators.dedup import folded, normalized_fingerprint, similarity
from lexiloom.operators.evaluation import fact_present, outcome
from lexiloom.operators.retrieval import citations, dot, norm, parse_order, passage_markup, prompt, tokens, web_search
from lexiloom.operators.sensitive import luhn_valid, verhoeff_valid
from lexiloom.operators.usage import worst_case
from lexiloom.sources.delimited import markdown_line, plain_line, safe_cell
from lexiloom.sources.urls import bounded_key, canonical_url, in_scope, origin, strip_tracking

__all__ = [
    "bounded_key", "canonical_url", "citations", "common_prefix", "dot", "embedding_text", "fact_present", "fingerprint", "fingerprint_v2", "folded", "in_scope", "luhn_valid", "markdown_line", "norm",
    "normalized_fingerprint", "origin", "outcome", "parse_order", "passage_markup", "plain_line", "prompt", "safe_cell", "similarity", "standard_clean",
    "strip_tracking", "tokens", "verhoeff_valid", "web_search", "worst_case",
]
