"""Stable result schemas, acceptance policies, and the rule record."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Names and order of the result columns.
IDENTITY = [("fact_order", "long"), ("fact_id", "string"), ("path", "string"), ("start_line", "long"), ("start_column", "long"), ("end_line", "long"), ("end_column", "long"), ("language", "string")]
VALUES = [*IDENTITY, ("integer_value", "long"), ("boolean_value", "boolean"), ("float_value", "double"), ("category_value", "string"), ("finding_count", "long")]
FINDINGS = [
    ("fact_id", "string"), ("finding_order", "long"), ("message", "string"), ("path", "string"), ("start_line", "long"), ("start_column", "long"), ("end_line", "long"), ("end_column", "long"),
    ("measurement_names", "array<string>"), ("measurement_values", "array<double>"), ("measurement_units", "array<string>"), ("evidence", "array<string>"), ("choice_question", "string"),
    ("choice_options", "array<string>"), ("provenance_backend", "string"), ("provenance_model", "string"), ("provenance_reasoning_effort", "string"), ("provenance_input_tokens", "long"),
    ("provenance_cached_input_tokens", "long"), ("provenance_output_tokens", "long"), ("provenance_reasoning_tokens", "long"),
]
REWRITES = [("fact_id", "string"), ("rewrite_order", "long"), ("kind", "string"), ("source", "string"), ("placement", "string"), ("name", "string"), ("symbol_id", "string"), ("symbol_name", "string"), ("references_complete", "boolean")]
NODES = [("fact_id", "string"), ("rewrite_order", "long"), ("role", "string"), ("ordinal", "long"), ("id", "string"), ("path", "string"), ("start_line", "long"), ("start_column", "long"), ("end_line", "long"), ("end_column", "long"), ("kind", "string"), ("text", "string")]
IMPORTS = [("fact_id", "string"), ("rewrite_order", "long"), ("ordinal", "long"), ("module", "string"), ("name", "string"), ("alias", "string"), ("level", "long"), ("type_only", "boolean")]
SUMMARY = [("rule_order", "long"), ("rule", "string"), ("observation_count", "long"), ("unassessed_count", "long"), ("failure_count", "long"), ("finding_count", "long")]


def schema(columns: list[tuple[str, str]]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in columns))


def conform(frame: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """The frame with exactly these columns and types; a column it lacks is null."""
    have = set(frame.columns)
    return frame.selectExpr(*(f"CAST({f'`{n}`' if n in have else 'NULL'} AS {t}) AS `{n}`" for n, t in columns))


@dataclass(frozen=True)
class Boolean:
    """One expected Boolean. A null value is unassessed, never failed."""

    expected: bool = False

    def verdict(self) -> tuple[Column, Column]:
        value = F.col("boolean_value")
        return F.coalesce(value != self.expected, F.lit(False)), value.isNull()


@dataclass(frozen=True)
class Numeric:
    """A closed interval."""

    minimum: float | None = None
    maximum: float | None = None

    def __post_init__(self) -> None:
        if self.minimum is not None and self.maximum is not None and self.minimum > self.maximum:
            raise ValueError("the minimum is above the maximum")

    def verdict(self) -> tuple[Column, Column]:
        value = F.coalesce(F.col("float_value"), F.col("integer_value").cast("double"))
        failed = F.lit(False)
        if self.minimum is not None:
            failed = failed | (value < self.minimum)
        if self.maximum is not None:
            failed = failed | (value > self.maximum)
        return F.coalesce(failed, F.lit(False)), value.isNull()


@dataclass(frozen=True)
class Category:
    """Good, neutral and bad categories. Neutral, unknown and null ones are unassessed."""

    good: frozenset[str] = frozenset()
    neutral: frozenset[str] = frozenset()
    bad: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        if not (self.good or self.neutral or self.bad):
            raise ValueError("a category policy needs a category")
        if len(self.good) + len(self.neutral) + len(self.bad) != len(self.good | self.neutral | self.bad):
            raise ValueError("a category stands in two groups")

    def verdict(self) -> tuple[Column, Column]:
        value = F.col("category_value")
        failed = F.coalesce(value.isin(sorted(self.bad)), F.lit(False))
        return failed, F.coalesce(~value.isin(sorted(self.good | self.bad)), F.lit(True))


Policy = Boolean | Numeric | Category


def default_policy(output: str) -> Policy | None:
    """Booleans are expected false, integers at most 0; percentages and categories are only measured."""
    return {"boolean": Boolean(), "integer": Numeric(maximum=0)}.get(output)


@dataclass
class Fix:
    """Requested rewrites with their nodes and imports."""

    rewrites: DataFrame
    nodes: DataFrame | None = None
    imports: DataFrame | None = None
    summary: str = ""


@dataclass
class Result:
    """What a rule returns: one value per fact, and optionally findings and a fix."""

    values: DataFrame
    findings: DataFrame | None = None
    fix: Fix | None = None


@dataclass(frozen=True)
class Rule:
    """A pure function from fact tables to a result, with its contract."""

    id: str
    build: Callable[..., Result]
    families: tuple[str, ...]
    output: str
    policy: Policy | None
    language: str | None = None
    safety: str | None = None
    about: str = ""
    settings: dict = field(default_factory=dict)
