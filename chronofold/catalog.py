"""The engine's registered queries and their SQL equivalents."""

from __future__ import annotations

from functools import partial
from inspect import signature

from .operators import exchange, folds, graph, lifecycle, rules, search, similarity, vectors
from .plans import datasets, metrics, pairs, ranking, temporal, text
from .plans.dialect import DUCK, plans, run
from .streaming import ledger, verifier

FLAGSHIP = "hybrid_search"
#: Importing these registers their plans.
MODULES = (temporal, text, pairs, ranking, metrics, datasets)


def apply(spark, name: str, sf_dir: str | None = None, **inputs):
    """Run one operator on the caller's DataFrames.

    ``inputs`` are given under the name of a table or relation of the plan: ``said(bank, ord, day, text)``,
    ``asked(qid, bank, day, question, answer)``, ``phrases(id, phrase, today)`` or any driver table. Tables
    that are not given are read from ``sf_dir``. Folds, joins and graph operators that work on statements take them the same way.
    """
    operator = {"scenario_copies": similarity.scenario_copies, **queries()}[name]
    if "inputs" not in signature(operator).parameters:
        raise ValueError(f"{name} works on tables alone")
    return operator(spark, sf_dir, inputs=inputs)


def queries() -> dict:
    return {name: partial(run, statement=p) for name, p in plans().items()} | folds.queries() | graph.queries() | verifier.queries() | ledger.queries() | exchange.queries() | similarity.queries() | search.queries() | rules.queries() | lifecycle.queries() | vectors.queries()


def oracle_sql() -> dict[str, str]:
    """Folds have none: their result depends on the order of rows."""
    return {name: p(DUCK) for name, p in plans().items()} | graph.oracle_sql() | exchange.oracle_sql() | similarity.oracle_sql() | search.oracle_sql()
