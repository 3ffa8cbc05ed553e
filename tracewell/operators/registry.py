"""A registry of named operators with described parameters, and calls by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from . import browse, evidence, relational, retrieval


@dataclass(frozen=True)
class Operator:
    name: str
    description: str
    run: Callable[..., DataFrame]
    parameters: dict[str, str] = field(default_factory=dict)
    category: str = "analysis"


_registered: dict[str, Operator] = {}


def register(name: str, description: str, category: str = "analysis", **parameters: str):
    """Decorator: makes a DataFrame function callable by name; ``parameters`` map names to JSON types."""

    def wrap(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _registered:
            raise ValueError(f"{name} is registered already")
        _registered[name] = Operator(name, description, run, parameters, category)
        return run

    return wrap


def schemas(category: str | None = None) -> list[dict]:
    """What each operator is and takes, as JSON schema."""
    return [
        {"name": o.name, "description": o.description, "category": o.category, "parameters": {"type": "object", "properties": {k: {"type": t} for k, t in o.parameters.items()}, "required": list(o.parameters)}}
        for o in _registered.values()
        if category in (None, o.category)
    ]


def execute(name: str, df: DataFrame, **arguments) -> dict:
    """{success, result} or {success, error}; the result is a DataFrame that nothing has run yet."""
    operator = _registered.get(name)
    if operator is None:
        return {"success": False, "error": f"unknown operator {name}"}
    missing = set(operator.parameters) - set(arguments)
    if missing:
        return {"success": False, "error": f"missing {', '.join(sorted(missing))}"}
    try:
        return {"success": True, "result": operator.run(df, **arguments)}
    except Exception as e:  # the caller is told, as of any other failure
        return {"success": False, "error": str(e)}


def execute_all(calls: list[tuple[str, dict]], df: DataFrame, most: int = 5) -> list[dict]:
    """Runs the first ``most`` calls; the rest are refused."""
    return [execute(name, df, **arguments) if i < most else {"success": False, "error": f"more than {most} calls"} for i, (name, arguments) in enumerate(calls)]


register("filter_and_count", "rows whose columns contain patterns", "tables", filters="object")(relational.filter_and_count)
register("value_distribution", "counts and shares of a column's values", "tables", column="string")(relational.value_distribution)
register("cross_tabulate", "counts of value pairs of two columns", "tables", a="string", b="string")(relational.cross_tabulate)
register("distribution_stats", "most frequent items of each group", "tables", group="string", item="string", k="integer")(relational.top_per_group)
register("outlier_score", "z-scores of a value in its group", "statistics", group="string", value="string")(relational.z_scores)
register("nearest_neighbors", "most similar vectors of query vectors", "vectors", queries="object", k="integer")(retrieval.nearest)
register("cosine_similarity", "how alike two named vectors are", "vectors", names="array")(retrieval.pairwise)
register("pairwise_distances", "distances of up to ten named vectors", "vectors", names="array")(retrieval.pairwise)
register("cluster_membership", "the cluster of each vector", "vectors", default="integer")(browse.clustered)
register("search_papers", "lexical ranking of documents", "retrieval", terms="object")(retrieval.bm25)
register("feature_importance", "weighted terms of each row", "vectors", key="string", words="string")(retrieval.tf_idf)
register("leaderboard", "ranked methods of each cell", "evidence")(evidence.leaderboard)
register("cross_validation", "cells that several papers report", "evidence")(evidence.cross_validation)
