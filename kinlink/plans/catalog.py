"""All registered queries of the reference's operators, with their DuckDB SQL."""

from __future__ import annotations

from kinlink.plans import queries_features, queries_linkage, queries_more, queries_relational

_ALL = (queries_relational.QUERIES, queries_linkage.QUERIES, queries_features.QUERIES, queries_more.QUERIES)


def queries() -> dict:
    return {name: fn for group in _ALL for name, (fn, _) in group.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for group in _ALL for name, (_, text) in group.items() if text}
