"""Builders that bring a rule's rows into the result schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.facts import FactTable
from .contracts import FINDINGS, IMPORTS, NODES, REWRITES, VALUES, Fix, Result, conform


def _values(frame: DataFrame, column: str, value: Column | str, kind: str, count: Column | None) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    made = frame.withColumns({column: value.cast(kind), "finding_count": F.lit(0) if count is None else count})
    other = [n for n, _ in VALUES if n.endswith("_value") and n != column and n in made.columns]
    return conform(made.drop(*other) if other else made, VALUES)


def integer(frame: DataFrame, value: Column | str, findings: DataFrame | None = None, count: Column | None = None, fix: Fix | None = None) -> Result:
    return Result(_values(frame, "integer_value", value, "long", F.col(value) if isinstance(value, str) and count is None else count), findings, fix)


def boolean(frame: DataFrame, value: Column | str, findings: DataFrame | None = None, count: Column | None = None, fix: Fix | None = None) -> Result:
    return Result(_values(frame, "boolean_value", value, "boolean", count), findings, fix)


def floating(frame: DataFrame, value: Column | str, findings: DataFrame | None = None, count: Column | None = None, fix: Fix | None = None) -> Result:
    return Result(_values(frame, "float_value", value, "double", count), findings, fix)


def category(frame: DataFrame, value: Column | str, findings: DataFrame | None = None, count: Column | None = None, fix: Fix | None = None) -> Result:
    return Result(_values(frame, "category_value", value, "string", count), findings, fix)


def findings(rows: DataFrame, message: Column, measurements: tuple[tuple[str, Column, str], ...] = (), order: Column | None = None, evidence: Column | None = None, question: Column | None = None, options: tuple[str, ...] = ()) -> DataFrame:
    """One finding per row. Without a stated order, rows are numbered from 0 by their place within the fact."""
    have = rows.columns
    if order is None:
        keys = [c for c in ("ordinal", "path", "start_line", "start_column") if c in have]
        order = F.row_number().over(Window.partitionBy("fact_id").orderBy(*keys, message)) - 1
    # Columns a finding lacks are filled by conform; only what differs from that is made here.
    made = {"finding_order": order, "message": message}
    if measurements:
        made |= {
            "measurement_names": F.array(*(F.lit(n) for n, _, _ in measurements)),
            "measurement_values": F.array(*(v.cast("double") for _, v, _ in measurements)),
            "measurement_units": F.array(*(F.lit(u) for _, _, u in measurements)),
        }
    if evidence is not None:
        made["evidence"] = evidence
    if question is not None:
        made["choice_question"] = question
    if options:
        made["choice_options"] = F.array(*map(F.lit, options))
    found = rows.withColumns(made)
    have = set(found.columns)
    empty = [(n, t) for n, t in FINDINGS if t.startswith("array") and n not in have]
    return conform(found.selectExpr("*", *(f"CAST(array() AS {t}) AS {n}" for n, t in empty)) if empty else found, FINDINGS)


def fix(rewrites: DataFrame, nodes: DataFrame | None = None, imports: DataFrame | None = None, summary: str = "") -> Fix:
    return Fix(conform(rewrites, REWRITES), None if nodes is None else conform(nodes, NODES), None if imports is None else conform(imports, IMPORTS), summary)


# --- results that several rules can share one scan for ----------------------------------------------------------------


def located(rows: DataFrame) -> DataFrame:
    """Child rows with a span: their line, from its start to its end."""
    if "start_line" in rows.columns:
        return rows
    line = F.col("line") if "line" in rows.columns else F.lit(1)
    return rows.withColumns({"start_line": line.cast("long"), "start_column": F.lit(0).cast("long"), "end_line": line.cast("long"), "end_column": F.lit(0).cast("long")})


class Counting:
    """The number of a relation's rows that meet a condition, per fact. Rules over one relation are judged in one scan of it."""

    output, fix = "integer", None

    def __init__(self, table: FactTable, relation: str, condition: Column, message: Column):
        self.table, self.relation, self.condition, self.message = table, relation, condition, message

    @property
    def rows(self) -> DataFrame:
        return self.table.relation(self.relation).where(self.condition)

    @property
    def values(self) -> DataFrame:
        return integer(self.table.counted(self.rows), "count").values

    @property
    def findings(self) -> DataFrame:
        return findings(located(self.rows), self.message)


class Measure:
    """A value of every fact from its own columns. Rules over one fact relation are judged in one scan of it."""

    fix = None

    def __init__(self, table: FactTable, value: Column, message: Column, output: str, unit: str = "count"):
        self.table, self.value, self.message, self.output, self.unit = table, value, message, output, unit

    @property
    def shown(self) -> Column:
        """Which facts have a finding: those whose flag holds, or all that have a value."""
        return F.coalesce(self.value, F.lit(False)) if self.output == "boolean" else F.lit(True)

    @property
    def typed(self) -> Column:
        return F.coalesce(self.value, F.lit(False)) if self.output == "boolean" else self.value.cast("long")

    @property
    def values(self) -> DataFrame:
        facts = self.table.facts()
        return boolean(facts, self.typed).values if self.output == "boolean" else integer(facts, self.typed, count=F.lit(1)).values

    @property
    def findings(self) -> DataFrame:
        measured = () if self.output == "boolean" else ((self.unit, self.typed, self.unit),)
        return findings(self.table.facts().where(self.shown), self.message, measured, order=F.lit(0))
