"""All named queries and their check SQL."""

import importlib

from relyframe.catalog.registry import ORACLE, QUERIES

SECTIONS = [
    "sources_q", "filters_q", "joins_q", "aggregates_q", "ordered_q", "functions_q", "rules_q", "findings_q",
    "scoring_q", "graph_q", "stream_q",
]

for _s in SECTIONS:
    importlib.import_module(f"relyframe.catalog.{_s}")


def queries():
    return dict(sorted(QUERIES.items()))


def oracle_sql():
    return dict(sorted(ORACLE.items()))
