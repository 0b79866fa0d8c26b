"""Operators over whole source files: syntax failures, files nobody wrote by hand, and natural language inside code.

All three read file_id, path and text of a file table, one pass per file inside `mapInPandas`, without a shuffle of the
texts. Repeated rows of a file give one result row; of several texts of a file the latest (by observed_at and ingested_at,
where the table has them, then by hash) counts. A null text is no file and gives no row; an empty text is valid source
without pieces; a null path or unknown suffix is read as no language and is neither parsed nor searched. Other columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import spread, written
from . import origin, pieces, prose
from .lexing import SUFFIXES, Parser, lexer, normalised, tables

_PARSERS: dict[str, Parser] = {}
#: Labelled documents the language models are trained on, at most this many of each language, none above LABELLED_BYTES.
LABELLED, LABELLED_BYTES = 120, 1 << 16
_VERSION = "seen timestamp, arrived timestamp, version long"
#: Outside libraries' texts are indexed on every executor only below this size; the table is a fixed one.
UPSTREAM_BOUND = 64 << 20


def language_of_path(path: str | None) -> str | None:
    return SUFFIXES.get(path.rsplit(".", 1)[-1]) if path and "." in path else None


def first_error(language: str, text: str, table: dict, scanned=None) -> int:
    """Line of the first error of a text the grammar of its language rejects, or 0."""
    parser = _PARSERS.get(language)
    if parser is None:
        parser = _PARSERS[language] = Parser(language, table[language])
    return parser.error_line(text, scanned)


def _inputs(files: DataFrame) -> DataFrame:
    """file_id, path, text and the version of every row of a file table."""
    time = lambda c: (F.col(c) if c in files.columns else F.lit(None)).cast("timestamp")
    return files.where("text IS NOT NULL").select("file_id", "path", "text", time("observed_at").alias("seen"), time("ingested_at").alias("arrived"), F.xxhash64("path", "text").alias("version"))


def _latest(found: DataFrame, *columns: str) -> DataFrame:
    """One row per file, that of its latest version. Rows hold no texts here; equal ones are reduced in each task first."""
    order = F.struct(F.coalesce("seen", F.lit(0).cast("timestamp")), F.coalesce("arrived", F.lit(0).cast("timestamp")), "version")
    return found.groupBy("file_id").agg(F.max_by(F.struct(*columns), order).alias("last")).select("file_id", "last.*")


def parse_errors(files: DataFrame) -> DataFrame:
    """file_id, language, error_line (0: it parses) of every distinct file with a known suffix.

    The grammars' tables (a few MB, fixed by the grammars) are built once on the driver and broadcast.
    """
    shared = files.sparkSession.sparkContext.broadcast(tables())

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = shared.value
        for batch in batches:
            batch["language"] = [language_of_path(path) for path in batch["path"]]
            batch = batch[batch["language"].notna()]
            lines = [first_error(language, normalised(text), table) for language, text in zip(batch["language"], batch["text"])]
            yield batch.drop(columns=["path", "text"]).assign(error_line=lines)

    return _latest(spread(_inputs(files)).mapInPandas(parse, f"file_id long, {_VERSION}, language string, error_line long"), "language", "error_line")


def failure_rates(files: DataFrame, errors: DataFrame, scans: DataFrame) -> DataFrame:
    """Failures and files per repository and language, beside the repository's latest scan totals."""
    owner = files.groupBy("file_id").agg(F.min("repository").alias("repository"))
    rates = errors.join(owner, "file_id").groupBy("repository", "language").agg(F.count("*").alias("files"), F.sum((F.col("error_line") > 0).cast("long")).alias("failures"))
    latest = scans.groupBy("repository").agg(F.max_by(F.struct("file_count", "parse_failure_count"), F.struct("finished_at", "scan_id")).alias("last"))
    return rates.join(latest, "repository", "left").select(
        "repository", "language", "files", "failures", (F.col("failures") / F.col("files")).alias("failure_rate"),
        F.col("last.file_count").alias("scan_file_count"), F.col("last.parse_failure_count").alias("scan_parse_failure_count"),
    )


def unwritten_files(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """file_id, category, rule of the files nobody wrote by hand (see `origin.category`).

    upstream: the outside libraries' files. Its size is checked against UPSTREAM_BOUND before it is sent to executors;
    a larger one is refused, since it would no longer be the fixed table this operator is made for.
    """
    bounded = upstream.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    if bounded > UPSTREAM_BOUND:
        raise ValueError(f"the outside libraries' texts have {bounded} bytes; the bound is {UPSTREAM_BOUND}")
    index = files.sparkSession.sparkContext.broadcast(origin.Upstream([r["text"] for r in upstream.select("text").collect()]))

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        outside = index.value
        for batch in batches:
            found = [origin.category(p, t, outside) or (None, None) for p, t in zip(batch["path"], batch["text"])]
            yield batch.drop(columns=["path", "text"]).assign(category=[c for c, _ in found], rule=[r for _, r in found])

    return _latest(spread(_inputs(files)).mapInPandas(sort, f"file_id long, {_VERSION}, category string, rule string"), "category", "rule").where("category IS NOT NULL")


def with_history(found: DataFrame, files: DataFrame, history: DataFrame) -> DataFrame:
    """The found files with repository, path, byte_count (of the text where the column is null) and line_count of the history."""
    facts = files.groupBy("file_id").agg(F.min("repository").alias("repository"), F.min("path").alias("path"), F.coalesce(F.max("byte_count"), F.max(F.octet_length("text")).cast("long")).alias("byte_count"))
    lines = history.groupBy("repository", "path").agg(F.max("line_count").alias("line_count"))
    return facts.join(found, "file_id").join(lines, ["repository", "path"], "left").select("file_id", "repository", "path", "category", "rule", "byte_count", "line_count")


#: place: the number of the piece within its file or comment group; -1: a row that only tells a file's version.
_SPAN = f"origin string, ref_id long, {_VERSION}, start_line long, place long, bytes long, hash binary, text string"
_SPAN_NAMES = ["origin", "ref_id", "seen", "arrived", "version", "start_line", "place", "bytes", "hash", "text"]


def _spans(found, seen: set) -> pd.DataFrame:
    """Rows of spans; a text goes along where its hash is new to the task."""
    rows = []
    for *head, text in found:
        if text is None:
            rows.append((*head, None, None))
            continue
        digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        first = digest not in seen
        if first:
            if len(seen) > 500_000:
                seen.clear()
            seen.add(digest)
        rows.append((*head, digest, text.encode("utf-8", "replace").decode() if first else None))
    return pd.DataFrame(rows, columns=_SPAN_NAMES)


def file_spans(files: DataFrame) -> DataFrame:
    """Comments and literals of the files that parse, as spans that may be prose, with a 128-bit hash; a text is sent once per task.

    A span without four blank-separated parts or a Chinese or Japanese sign cannot be prose and stays out.
    """
    shared = files.sparkSession.sparkContext.broadcast(tables())

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, seen = shared.value, set()
        for batch in batches:
            found = []
            for file, path, text, *version in zip(*(batch[c] for c in ("file_id", "path", "text", "seen", "arrived", "version"))):
                found.append(("source_file", file, *version, None, -1, 0, None))
                language = language_of_path(path)
                if not language:
                    continue
                text = normalised(text)
                scanned = list(lexer(language).scan(text))
                if not first_error(language, text, table, scanned):
                    found += [("source_file", file, *version, line, place, size, piece) for place, (line, _, piece, size) in enumerate(pieces.pieces_of(text, language, scanned)) if prose.maybe(piece)]
            yield _spans(found, seen).astype({"start_line": "Int64"})

    return spread(_inputs(files)).mapInPandas(extract, _SPAN)


def group_spans(groups: DataFrame) -> DataFrame:
    """Spans of comment groups: the body of a comment, the literal of a string. Both null: none."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for batch in batches:
            found = []
            for group, body, expression, line in zip(batch["group_id"], batch["body"], batch["expression"], batch["start_line"]):
                for place, piece in ([(0, normalised(body))] if body is not None else []) + ([(1, pieces.literal(expression))] if expression is not None else []):
                    if prose.maybe(piece):
                        found.append(("comment_group", group, None, None, 0, None if pd.isna(line) else int(line), place, len(piece.encode("utf-8", "replace")), piece))
            yield _spans(found, seen).astype({"start_line": "Int64"})

    return groups.select("group_id", "body", "expression", "start_line").mapInPandas(extract, _SPAN)


def language_model(documents: DataFrame | None) -> prose.Model:
    """The language models, trained on at most LABELLED documents of each label (those with the least hashes, so the choice can be repeated).

    Null labels, labels of other languages and texts above LABELLED_BYTES are left out. Without documents only the
    function words are known.
    """
    if documents is None:
        return prose.Model({})
    label = F.substring_index(F.lower(F.trim("lang")), "-", 1)
    labelled = documents.select(label.alias("label"), "text").where(F.col("label").isin(list(prose.LANGUAGES)) & (F.octet_length("text") <= LABELLED_BYTES))
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("text"), "text"))
    rows = labelled.withColumn("rank", rank).where(F.col("rank") <= LABELLED).select("label", "text").collect()
    return prose.train([(r["label"], r["text"]) for r in rows])


def prose_spans(files: DataFrame, groups: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """origin, ref_id, start_line, nl_lang, bytes of every prose piece, one row for each; repeated input rows count once.

    The spans are written once. Each distinct hash is then classified once, and its label joined back on the hash; only
    distinct texts and 16-byte hashes are shuffled. A hash that holds very many spans is one row on the label side, so
    adaptive execution may split the other side of such a partition. documents: labelled texts to train the languages on.
    bytes are those of the piece's source in UTF-8 with line feeds as line ends, markers and quotes included.
    """
    model = files.sparkSession.sparkContext.broadcast(language_model(documents))
    spans = written(file_spans(files).unionByName(group_spans(groups)))
    distinct = spans.where(F.col("text").isNotNull()).groupBy("hash").agg(F.first("text").alias("text"))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["nl_lang"] = [prose.language_of(t, model.value) for t in batch["text"]]
            yield batch.loc[batch["nl_lang"].notna(), ["hash", "nl_lang"]]

    labels = distinct.mapInPandas(classify, "hash binary, nl_lang string")
    versions = spans.where("place = -1").select(F.col("ref_id").alias("file_id"), "seen", "arrived", "version")
    several = versions.groupBy("file_id").agg((F.min("version") != F.max("version")).alias("several")).where("several").select("file_id")
    last = _latest(versions.join(several, "file_id", "left_semi"), "version").select(F.lit("source_file").alias("origin"), F.col("file_id").alias("ref_id"), F.col("version").alias("last"))
    named = spans.where("place >= 0").select("origin", "ref_id", "version", "start_line", "bytes", "place", "hash").join(labels, "hash").drop("hash")
    named = named.join(last, ["origin", "ref_id"], "left").where("last IS NULL OR last = version")
    return named.select("origin", "ref_id", "start_line", "nl_lang", "bytes", "place").distinct().drop("place")


def language_shares(spans: DataFrame, files: DataFrame) -> DataFrame:
    """Bytes of prose per file and language, and their share of the bytes of the file's latest text (line ends counted as one)."""
    plain = F.replace(F.replace("text", F.lit("\r\n"), F.lit("\n")), F.lit("\ufeff"), F.lit(""))
    size = F.octet_length(plain).cast("long").alias("file_bytes")
    sizes = _latest(_inputs(files).select("file_id", "seen", "arrived", "version", size), "file_bytes").withColumnRenamed("file_id", "ref_id")
    by = spans.where("origin = 'source_file'").groupBy("ref_id", "nl_lang").agg(F.sum("bytes").alias("prose_bytes"), F.count("*").alias("pieces"))
    return by.join(sizes, "ref_id").select(F.col("ref_id").alias("file_id"), "nl_lang", "pieces", "prose_bytes", "file_bytes", F.when(F.col("file_bytes") > 0, F.col("prose_bytes") / F.col("file_bytes")).otherwise(0.0).alias("share"))
