"""Query name -> Spark callable, and the SQL that computes the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(fn: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql.strip()
            return fn
        return keep


def sql_ratio(num: str, den: str, scale: int = 100, digits: int = 1) -> str:
    """SQL for ``rounded_ratio``: integer arithmetic, ties to even."""
    n, d = f"(abs({num})::HUGEINT*{scale * 10 ** digits})", f"abs({den})::HUGEINT"
    q = f"({n}//{d})"
    r = f"(({n}-{q}*{d})*2)"
    return (f"CASE WHEN ({den})=0 THEN NULL ELSE (CASE WHEN (({num})<0)<>(({den})<0) THEN -1 ELSE 1 END)"
            f"*({q}+CASE WHEN {r}>{d} OR ({r}={d} AND {q}%2=1) THEN 1 ELSE 0 END)::DOUBLE/{10 ** digits} END")


def sql_floor_div(num: str, den: str) -> str:
    return f"CAST(floor(({num})::DECIMAL(38,0)/NULLIF({den},0)) AS BIGINT)"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_first_match(column: str, rules, flag: str = "", default: str = "NULL") -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, {sql_text(flag + p)}) THEN {sql_text(v)}" for p, v in rules)
    return f"CASE {whens} ELSE {default} END"


def sql_pick(index: str, values) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {sql_text(v)}" for i, v in enumerate(values)) + " END"
