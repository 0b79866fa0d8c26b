"""Queries of the operators in this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import files, leaks, mixing, repeats, spans


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_tokens(spans.shared_windows(table(spark, d, "clone_token")))


def p2_spans(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "clone_token")
    return spans.shared_spans(spans.shared_windows(tokens), tokens)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return files.prose_spans(table(spark, d, "source_file"), table(spark, d, "comment_group"), table(spark, d, "documents")).select("origin", "ref_id", "start_line", "nl_lang").distinct()


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "source_file")
    return files.language_shares(files.prose_spans(source, table(spark, d, "comment_group"), table(spark, d, "documents")), source)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return files.unwritten_files(table(spark, d, "source_file"), table(spark, d, "upstream_file")).select("file_id", "category")


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "source_file")
    return files.with_history(files.unwritten_files(source, table(spark, d, "upstream_file")), source, table(spark, d, "file_history"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_errors(table(spark, d, "source_file")).where("error_line > 0").select("file_id")


def p6_errors(spark: SparkSession, d: str) -> DataFrame:
    """The line of the first unrecoverable error of every file that does not parse."""
    return files.parse_errors(table(spark, d, "source_file")).where("error_line > 0")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "source_file")
    return files.failure_rates(source, files.parse_errors(source), table(spark, d, "scan_stats"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item")).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """Length and places of the longest match of each document and item."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The documents left after removal."""
    documents = table(spark, d, "documents")
    return leaks.without_leaks(documents, leaks.leaks(documents, table(spark, d, "eval_item"))).select("doc_id", "source", "n_chars")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_target")
    return mixing.reached(mixing.mix(table(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated(table(spark, d, "documents")).where(f"words > 0 AND share >= {repeats.SHARE}").select("doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeated(table(spark, d, "documents"))


def p9_perplexity(spark: SparkSession, d: str) -> DataFrame:
    """Perplexity under the corpus model and the band of the document's language."""
    documents = table(spark, d, "documents")
    return repeats.bands(repeats.perplexity(documents), documents)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


_P7 = """
WITH item AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM eval_item),
gram AS (SELECT DISTINCT item_id, w[i:i + 11] AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM item WHERE len(w) >= 12)),
doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
run AS (SELECT DISTINCT doc_id, w[i:i + 11] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM doc WHERE len(w) >= 12))
"""
_P9 = """
WITH doc AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{L}+') AS w FROM documents WHERE text IS NOT NULL),
run AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM doc WHERE len(w) >= 8)),
again AS (SELECT doc_id, g FROM run GROUP BY ALL HAVING count(*) > 1),
word AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS k FROM run JOIN again USING (doc_id, g)),
n AS (SELECT doc_id, count(*) AS m FROM word GROUP BY ALL),
share AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS words, coalesce(m, 0) AS repeated_words, coalesce(m, 0) / greatest(len(w), 1) AS share FROM doc LEFT JOIN n USING (doc_id))
"""
_P2 = """
WITH token AS (SELECT stream_id, token_no, min({'s': symbol, 'i': identity}) AS t FROM clone_token WHERE stream_id IS NOT NULL AND token_no IS NOT NULL GROUP BY ALL),
kind AS (SELECT t, row_number() OVER () AS id FROM (SELECT DISTINCT t FROM token)),
named AS MATERIALIZED (SELECT stream_id, token_no, id FROM token JOIN kind ON token.t IS NOT DISTINCT FROM kind.t),
run AS (SELECT stream_id, token_no, list(id) OVER w AS g, max(token_no) OVER w AS last FROM named WINDOW w AS (PARTITION BY stream_id ORDER BY token_no ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)),
whole AS MATERIALIZED (SELECT stream_id, token_no, md5(CAST(g AS VARCHAR)) AS g FROM run WHERE len(g) = 40 AND last = token_no + 39),
shared AS (SELECT g FROM whole GROUP BY g HAVING min(stream_id) <> max(stream_id)),
place AS MATERIALIZED (SELECT DISTINCT stream_id, unnest(range(token_no, token_no + 40)) AS k FROM whole JOIN shared USING (g))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2 + "SELECT stream_id, count(*) AS shared_tokens FROM place GROUP BY ALL",
        "p2_spans": _P2 + """, isle AS (SELECT stream_id, k, k - row_number() OVER (PARTITION BY stream_id ORDER BY k) AS g FROM place),
span AS (SELECT stream_id, min(k) AS first_token, max(k) AS last_token FROM isle GROUP BY stream_id, g), line AS (SELECT stream_id, token_no, min(line) AS line FROM clone_token GROUP BY ALL)
SELECT s.stream_id, first_token, last_token, a.line AS first_line, b.line AS last_line FROM span s LEFT JOIN line a ON a.stream_id = s.stream_id AND a.token_no = first_token LEFT JOIN line b ON b.stream_id = s.stream_id AND b.token_no = last_token""",
        "p7_found": _P7 + "SELECT DISTINCT doc_id, item_id FROM run JOIN gram USING (g)",
        "p7_clean": _P7 + "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM run JOIN gram USING (g))",
        "p9_found": _P9 + "SELECT doc_id FROM share WHERE words > 0 AND 2 * repeated_words >= words",
        "p9_shares": _P9 + "SELECT doc_id, words, repeated_words, share FROM share",
    }
