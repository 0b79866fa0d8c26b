"""Batched closed-category classification of candidates.

Candidates are JSON texts made by Spark (nulls kept), answered in batches by a backend inside `mapInPandas`, and joined
back to their facts. A backend is any picklable callable from a list of texts to a list of (category, confidence);
KeywordBackend is a deterministic local one, so a run needs no network and can be repeated.

Defined cases: an answer outside the categories, a null candidate, or too little confidence is `uncertain`; equal
candidates are answered once per batch; a fact without candidates has no value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.facts import all_of, any_of
from ..plans import shaping
from ..plans.contracts import Category, Result

BATCH, LEAST_CONFIDENCE = 32, 0.6
Backend = Callable[[list[str]], list[tuple[str, float]]]


@dataclass(frozen=True)
class KeywordBackend:
    """The category most of whose words a text holds; equal counts go to the category named first, none to the default."""

    words: tuple[tuple[str, tuple[str, ...]], ...]
    default: str = "uncertain"

    def __call__(self, texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            low = text.lower()
            hits = [(sum(low.count(w) for w in words), name) for name, words in self.words]
            best = max((n for n, _ in hits), default=0)
            total = sum(n for n, _ in hits)
            out.append((next(name for n, name in hits if n == best), best / total) if best else (self.default, 1.0))
        return out


def candidates(frame: DataFrame, fields: list[str], records: Column | None = None, values: Column | None = None) -> DataFrame:
    """fact_id and the candidate's JSON: its fields, records and values; nulls stay visible."""
    parts = [F.struct(*fields).alias("fields")]
    if records is not None:
        parts.append(records.alias("records"))
    if values is not None:
        parts.append(values.alias("values"))
    return frame.select("fact_id", F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias("candidate"))


def classified(frame: DataFrame, backend: Backend, categories: tuple[str, ...], least: float = LEAST_CONFIDENCE, batch: int = BATCH) -> DataFrame:
    """fact_id, category, confidence of every candidate."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.iloc[at : at + batch]
                texts = [t for t in dict.fromkeys(part["candidate"]) if t is not None]
                known = dict(zip(texts, backend(texts))) if texts else {}
                rows = []
                for fact, text in zip(part["fact_id"], part["candidate"]):
                    name, sure = known.get(text, ("uncertain", 0.0))
                    rows.append((fact, name if name in categories and sure >= least else "uncertain", float(sure)))
                yield pd.DataFrame(rows, columns=["fact_id", "category", "confidence"])

    return frame.select("fact_id", "candidate").mapInPandas(ask, "fact_id string, category string, confidence double")


def result(facts: DataFrame, answers: DataFrame) -> Result:
    """The answers as category values of their facts."""
    return shaping.category(facts.join(answers, "fact_id"), F.col("category"))


@dataclass(frozen=True)
class Assessment:
    """Independent criteria and an ordered decision table: the first row all of whose criteria agree decides."""

    criteria: tuple[str, ...]
    table: tuple[tuple[str, tuple[tuple[str, str], ...]], ...]
    default: str
    uncertain: str = "uncertain"

    def decide(self, answers: DataFrame) -> DataFrame:
        """fact_id, category from rows (fact_id, criterion, answer). A fact must have all criteria; `unknown` to one is uncertain."""
        wide = answers.where(F.col("criterion").isin(*self.criteria)).groupBy("fact_id").agg(*(F.max(F.when(F.col("criterion") == c, F.col("answer"))).alias(c) for c in self.criteria))
        wide = wide.where(all_of(*(F.col(c).isNotNull() for c in self.criteria)))
        verdict = F.lit(self.default)
        for category, needs in reversed(self.table):
            verdict = F.when(all_of(*(F.col(c) == v for c, v in needs)), category).otherwise(verdict)
        unknown = any_of(*(F.col(c) == "unknown" for c in self.criteria))
        return wide.select("fact_id", F.when(unknown, self.uncertain).otherwise(verdict).alias("category"))


def policy(categories: tuple[str, ...], good: tuple[str, ...], neutral: tuple[str, ...] = ("uncertain",)) -> Category:
    """A policy in which every category that is neither good nor neutral is bad."""
    return Category(frozenset(good), frozenset(neutral), frozenset(categories) - set(good) - set(neutral))
