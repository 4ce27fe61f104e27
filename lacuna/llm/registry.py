"""The registered queries of this subpackage, and SQL for those it can express."""

from __future__ import annotations

import corpus_pipeline
from lacuna.llm.chat import chat_query
from lacuna.llm.classifier import quality_query
from lacuna.llm.lexical import LEXICAL_SQL, lexical_query
from lacuna.llm.lm import lm_query
from lacuna.llm.middles import MIDDLE_SQL, middle_query
from lacuna.llm.neighbours import neighbour_query
from lacuna.llm.packing import packing_query
from lacuna.llm.rules import RULES_SQL, rules_query
from lacuna.llm.sentencepieces import sentencepiece_query
from lacuna.llm.sharding import SHARDING_SQL, sharding_query
from lacuna.llm.simhash import simhash_query
from lacuna.llm.suffixes import SUFFIX_SQL, suffix_query
from lacuna.llm.urls import URL_SQL, url_query

QUERIES = {
    "op1_suffix_dedup": suffix_query,
    "op2_chat_formatting": chat_query,
    "op3_best_fit_packing": packing_query,
    "op4_url_filters": url_query,
    "op5_quality_rules": rules_query,
    "op6_simhash": simhash_query,
    "op7_neighbours": neighbour_query,
    "op8_pitman_yor": lm_query,
    "op9_sentencepiece": sentencepiece_query,
    "op10_quality_classifier": quality_query,
    "op11_fill_in_middle": middle_query,
    "op12_lexical_search": lexical_query,
    "op13_sharding": sharding_query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_suffix_dedup": SUFFIX_SQL,
    "op4_url_filters": URL_SQL,
    "op5_quality_rules": RULES_SQL,
    "op11_fill_in_middle": MIDDLE_SQL,
    "op12_lexical_search": LEXICAL_SQL,
    "op13_sharding": SHARDING_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
