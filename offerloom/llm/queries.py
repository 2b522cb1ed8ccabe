"""The registered queries of this subpackage."""

from offerloom.llm import (
    divergence,
    graph_search,
    language,
    line_join,
    ngram_filter,
    packing,
    phrases,
    rank_codec,
    simhash,
    simple8b,
    substrings,
    suffixes,
    turn_repair,
)

MODULES = (
    graph_search,
    divergence,
    simhash,
    substrings,
    ngram_filter,
    simple8b,
    rank_codec,
    line_join,
    suffixes,
    packing,
    phrases,
    language,
    turn_repair,
)


def all_queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql():
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
