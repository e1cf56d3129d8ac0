"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import quality_rules, decontaminate, grouped_ranking, lexical_search
from .bpe import op7_bpe
from .decontaminate import op1_decontamination
from .grouped_ranking import op13_grouped_ranking
from .html_extract import op9_html_extract
from .lexical_search import op12_lexical_search
from .minhash_dedup import op3_minhash_dedup
from .quality_rules import op5_quality_rules
from .secret_scan import op8_secret_scan
from .sharding import op2_sharding
from .substring_dedup import op10_substring_dedup
from .toxicity import op6_toxicity
from .url_filter import op4_url_filter
from .vector_search import op11_vector_search

QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_sharding, op3_minhash_dedup, op4_url_filter, op5_quality_rules,
        op6_toxicity, op7_bpe, op8_secret_scan, op9_html_extract, op10_substring_dedup,
        op11_vector_search, op12_lexical_search, op13_grouped_ranking,
    )
}

ORACLES = {
    "op1_decontamination": decontaminate.ORACLE, "op5_quality_rules": quality_rules.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE, "op13_grouped_ranking": grouped_ranking.ORACLE,
}
