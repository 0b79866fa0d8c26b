"""Classification queries over comments and documents, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.text import comments
from ..session import table
from . import classify

#: Words that hint at a comment's intent.
INTENT = (("warning", ("do not", "never", "cannot", "otherwise", "careful")), ("rationale", ("because", "reason", "so that", "instead")), ("historical", ("was written", "since", "after the", "moved")))
CATEGORIES = ("warning", "rationale", "historical")


def ctx_comment_intent(spark: SparkSession, d: str) -> DataFrame:
    """The intent of each comment with at least three tokens, and its verdict."""
    rows = comments(table(spark, d, "comment_group")).where("token_count >= 3").withColumn("fact_id", F.col("group_id").cast("string"))
    answers = classify.classified(classify.candidates(rows, ["body"]), classify.KeywordBackend(INTENT), CATEGORIES, least=0.0)
    return answers.select(F.col("fact_id").cast("long").alias("group_id"), "category")


def ctx_document_assessment(spark: SparkSession, d: str) -> DataFrame:
    """Documents assessed by three criteria and a decision table."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("fact_id"), F.length("text").alias("n"), F.col("text").contains("\n\n").alias("p"), F.col("text").startswith("#").alias("h"))
    ask = lambda name, yes: docs.select("fact_id", F.lit(name).alias("criterion"), F.when(yes, "yes").otherwise("no").alias("answer"))
    answers = ask("long", F.col("n") >= 1000).union(ask("divided", F.col("p"))).union(ask("headed", F.col("h")))
    table_ = (("article", (("long", "yes"), ("divided", "yes"), ("headed", "yes"))), ("essay", (("long", "yes"), ("divided", "yes"))), ("wall", (("long", "yes"), ("divided", "no"))))
    return classify.Assessment(("long", "divided", "headed"), table_, "note").decide(answers).select(F.col("fact_id").cast("long").alias("doc_id"), "category")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (ctx_comment_intent, ctx_document_assessment)}


def oracle_sql() -> dict[str, str]:
    def hits(words: tuple[str, ...]) -> str:
        return " + ".join(f"(length(b) - length(replace(b, '{w}', ''))) // {len(w)}" for w in words)

    return {
        "ctx_comment_intent": f"""WITH g AS (SELECT group_id, lower(body) AS b FROM comment_group WHERE body IS NOT NULL AND token_count >= 3 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY ingested_at DESC NULLS LAST) = 1),
h AS (SELECT group_id, {', '.join(f'{hits(w)} AS {n}' for n, w in INTENT)} FROM g)
SELECT group_id, CASE WHEN greatest(warning, rationale, historical) = 0 THEN 'uncertain' WHEN warning = greatest(warning, rationale, historical) THEN 'warning' WHEN rationale = greatest(warning, rationale, historical) THEN 'rationale' ELSE 'historical' END AS category FROM h""",
        "ctx_document_assessment": """SELECT doc_id, CASE WHEN length(text) >= 1000 AND contains(text, chr(10) || chr(10)) AND starts_with(text, '#') THEN 'article' WHEN length(text) >= 1000 AND contains(text, chr(10) || chr(10)) THEN 'essay' WHEN length(text) >= 1000 THEN 'wall' ELSE 'note' END AS category FROM documents""",
    }
