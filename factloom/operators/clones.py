"""Clone groups of token streams: maximal runs of tokens that stand at several places.

Every window of WINDOW tokens has a 128-bit hash; windows that occur once drop out before anything is joined. Windows
whose occurrences are all followed by the same next window belong to one longer run, so a run is read off as an island
of linked windows within each stream, and its places are grouped by its first window and its length. No pairs of places
are formed.

Rows without stream_id or token_no are left out; repeated rows count once; null symbols and identities equal null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import written

WINDOW = 40


def windows(tokens: DataFrame, size: int = WINDOW) -> DataFrame:
    """stream_id, token_no, hash of every full window, its tokens' hashes combined in order by doubling."""
    one = tokens.where("stream_id IS NOT NULL AND token_no IS NOT NULL").groupBy("stream_id", "token_no").agg(F.min(F.struct("symbol", "identity")).alias("t"))
    named = one.select("stream_id", "token_no", F.md5(F.to_json(F.struct(F.col("t.symbol").alias("s"), F.col("t.identity").alias("i")))).alias("h"))
    w = Window.partitionBy("stream_id").orderBy("token_no")
    covered, part, total, power, last = 0, "h", None, 1, named
    while True:
        if size & power:
            piece = F.lead(part, covered).over(w) if covered else F.col(part)
            last = last.withColumn(f"t{power}", piece if total is None else F.md5(F.concat(F.col(total), piece)))
            total, covered = f"t{power}", covered + power
        power *= 2
        if power > size:
            break
        last = last.withColumn(f"h{power}", F.md5(F.concat(F.col(part), F.lead(part, power // 2).over(w))))
        part = f"h{power}"
    whole = F.lead("token_no", size - 1).over(w) == F.col("token_no") + size - 1
    return last.select("stream_id", "token_no", F.when(whole, F.col(total)).alias("hash")).where("hash IS NOT NULL")


def groups(tokens: DataFrame, size: int = WINDOW) -> DataFrame:
    """clone, stream_id, first_token, length of every place of every maximal run that stands at two places or more."""
    all_ = written(windows(tokens, size))
    counted = all_.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    w = Window.partitionBy("stream_id").orderBy("token_no")
    places = all_.join(counted, "hash").withColumns({"next": F.lead("hash").over(w), "next_n": F.lead("n").over(w), "next_at": F.lead("token_no").over(w)})
    follows = F.when(F.col("next_at") == F.col("token_no") + 1, F.struct("next", "next_n"))
    # A window leads to the next one where all its places do and the next one has no others.
    link = places.withColumn("f", follows).groupBy("hash").agg(F.count_distinct("f").alias("k"), F.count("f").alias("m"), F.max("n").alias("n"), F.max("f").alias("f")).where("k = 1 AND m = n AND f.next_n = n").select("hash", F.lit(True).alias("linked"))
    marked = written(places.select("stream_id", "token_no", "hash").join(link, "hash", "left").select("stream_id", "token_no", "hash", F.coalesce("linked", F.lit(False)).alias("linked")))
    before = F.lag("linked").over(w) & (F.lag("token_no").over(w) == F.col("token_no") - 1)
    run = marked.withColumn("run", F.sum((~F.coalesce(before, F.lit(False))).cast("long")).over(w))
    out = run.groupBy("stream_id", "run").agg(F.min("token_no").alias("first_token"), (F.count("*") + size - 1).alias("length"), F.min_by("hash", "token_no").alias("clone"))
    return out.select("clone", "stream_id", "first_token", "length")


def summary(found: DataFrame) -> DataFrame:
    """clone, length, copies, streams of each group."""
    return found.groupBy("clone").agg(F.max("length").alias("length"), F.count("*").alias("copies"), F.count_distinct("stream_id").alias("streams"))


def with_lines(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """The places with repository, path and first and last line (null where the tokens have none)."""
    lines = tokens.where("stream_id IS NOT NULL AND token_no IS NOT NULL").groupBy("stream_id", "token_no").agg(F.min("line").alias("line"), F.min("repository").alias("repository"), F.min("path").alias("path"))
    first = lines.select("stream_id", F.col("token_no").alias("first_token"), F.col("line").alias("first_line"), "repository", "path")
    last = lines.select("stream_id", F.col("token_no").alias("last_token"), F.col("line").alias("last_line"))
    return found.withColumn("last_token", F.col("first_token") + F.col("length") - 1).join(first, ["stream_id", "first_token"]).join(last, ["stream_id", "last_token"])
