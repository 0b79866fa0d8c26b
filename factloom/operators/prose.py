"""Prose measures: uniformity of sentence and paragraph lengths, and concentration of sentence openers.

sections: fact_id, ordinal, text. All measures are higher-order functions over one row per section; only the maximum per
document is grouped. Null and empty texts have no sentences and measure 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def sentences(text: Column) -> Column:
    """Sentences end at full stops, exclamation and question marks outside code spans."""
    return F.filter(F.split(F.regexp_replace(text, "`[^`]*`", " "), r"[.!?]+"), lambda s: F.length(F.trim(F.regexp_replace(s, r"\s+", " "))) > 0)


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), lambda w: F.length(w) > 0)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: F.length(F.trim(F.regexp_replace(p, r"\s+", " "))) > 0)


def uniformity(counts: Column, minimum_words: int, minimum_entries: int) -> Column:
    """100 max(0, 1 - mean absolute deviation / mean) of the lengths that reach a minimum; null with too few of them."""
    kept = F.filter(counts, lambda n: n >= minimum_words)
    n = F.size(kept)
    mean = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / n
    held = F.transform(F.array(F.struct(kept.alias("k"), n.alias("n"), mean.alias("m"))), lambda h: F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(h["k"], F.lit(0.0), lambda a, x: a + F.abs(x - h["m"])) / h["n"] / h["m"]) * 100)
    return F.when(n >= minimum_entries, held[0])


def _highest(sections: DataFrame, value: Column, name: str) -> DataFrame:
    return sections.select("fact_id", value.alias("v")).groupBy("fact_id").agg(F.coalesce(F.max("v"), F.lit(0.0)).alias(name))


def sentence_uniformity(sections: DataFrame, minimum_sentences: int = 5, minimum_words: int = 3) -> DataFrame:
    # The lengths are a column of their own, so that a text is split once however often they are read.
    counts = F.transform(sentences(F.col("text")), lambda s: F.size(words(s)))
    return _highest(sections.select("fact_id", counts.alias("counts")), uniformity(F.col("counts"), minimum_words, minimum_sentences), "uniformity")


def paragraph_uniformity(sections: DataFrame, minimum_paragraphs: int = 4, minimum_words: int = 30) -> DataFrame:
    counts = F.transform(paragraphs(F.col("text")), lambda p: F.size(words(p)))
    return _highest(sections.select("fact_id", counts.alias("counts")), uniformity(F.col("counts"), minimum_words, minimum_paragraphs), "uniformity")


def opener_concentration(sections: DataFrame, minimum_sentences: int = 6, ignored: tuple[str, ...] = ("a", "i")) -> DataFrame:
    """fact_id, opener, share: the greatest share of one sentence opener in a section; of several equal ones the least word."""
    opener = F.transform(sentences(F.col("text")), lambda s: F.lower(words(s)[0]))
    rows = sections.select("fact_id", "ordinal", F.explode(opener).alias("opener")).where(~F.col("opener").isin(*ignored))
    counted = rows.groupBy("fact_id", "ordinal", "opener").agg(F.count("*").alias("n"))
    top = counted.groupBy("fact_id", "ordinal").agg(F.sum("n").alias("all"), F.min(F.struct((-F.col("n")).alias("n"), "opener")).alias("t")).where(F.col("all") >= minimum_sentences)
    best = top.select("fact_id", F.struct((F.col("t.n") * 100.0 / F.col("all")).alias("v"), F.col("t.opener").alias("opener")).alias("b")).groupBy("fact_id").agg(F.min(F.struct(F.col("b.v").alias("v"), "b.opener")).alias("b"))
    return sections.select("fact_id").distinct().join(best, "fact_id", "left").select("fact_id", "b.opener", F.coalesce(-F.col("b.v"), F.lit(0.0)).alias("share"))
