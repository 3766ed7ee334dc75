"""Line deduplication across documents, in native expressions alone.

Lines are normalised, exploded and hashed; a hash that enough documents hold keeps its lines in the smallest document only.
Each document gets the positions that it loses, and is put together from the others in their order.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACES = " \t\n\v\f\r"
#: The most hashes that are sent to every executor: those with more than such a share of all rows.
HOT_HASHES = 10_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and no other letter."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text key, text) of every row; null texts are empty.  The key tells texts of one id apart, should it repeat."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def hashed_lines(docs: DataFrame, *, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, lines): position and two 64-bit hashes of each line whose key has least_chars code points or more, for rows with an id."""
    rows = _lines(docs, id_col, text_col).where("id IS NOT NULL")
    rows = rows.select("id", "key", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("at", "line"))
    rows = rows.select("id", "key", "at", F.btrim("line", F.lit(SPACES)).alias("line")).where(F.char_length("line") >= least_chars)
    return rows.select("id", "key", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def frequent_lines(lines: DataFrame, least_docs: int = 2) -> DataFrame:
    """(h1, h2, first, n): the smallest document and the rows of each hash in least_docs documents or more."""
    counted = lines.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where(F.col("first") < F.col("last")).drop("last")
    if least_docs > 2:  # two documents show in the least and the greatest id; more have to be counted
        several = lines.join(counted.where(F.col("n") >= least_docs).select("h1", "h2"), ["h1", "h2"], "left_semi")
        several = several.groupBy("h1", "h2", "id").agg(F.lit(1)).groupBy("h1", "h2").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs)
        counted = counted.join(several.select("h1", "h2"), ["h1", "h2"], "left_semi")
    return counted


def dropped_positions(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, key, dropped): the positions that a row loses.

    Hashes with more than one in HOT_HASHES of all rows, HOT_HASHES at most, go to every task; the others are joined by
    shuffling, and none of them is a hot key.
    """
    total = frequent.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / HOT_HASHES
    found = lines.join(F.broadcast(frequent.where(hot)), ["h1", "h2"], "left")
    common = found.where("n IS NOT NULL").select("id", "key", "at", "first")
    others = found.where("n IS NULL").select("id", "key", "at", "h1", "h2").join(frequent.where(~hot), ["h1", "h2"]).select("id", "key", "at", "first")
    return common.unionByName(others).where(F.col("id") != F.col("first")).groupBy("id", "key").agg(F.collect_set("at").alias("dropped"))


def dedup_lines(docs: DataFrame, *, least_docs: int = 2, least_chars: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_lines, n_dropped and text, without the lines that least_docs documents or more share.

    A line's key is the line without white space at its ends and with A-Z lower-cased; keys shorter than least_chars never
    lose a line.  The smallest id that holds a key keeps all its lines.  A null or empty text is one empty line; a text that
    loses all its lines is empty.  Rows that repeat an id are one document, each put together by itself; rows with a null id
    are no document: they count for no line and stay whole.  Very long texts are handled like others, line by line; an empty
    table gives no row; other columns are not read.
    """
    lines = written(hashed_lines(docs, least_chars=least_chars, id_col=id_col, text_col=text_col), "line-hashes")
    frequent = written(frequent_lines(lines, least_docs), "frequent-lines")
    dropped = dropped_positions(lines, frequent)
    rows = _lines(docs, id_col, text_col)
    rows = rows.join(dropped.withColumnsRenamed({"id": "rid", "key": "rkey"}), (F.col("id") == F.col("rid")) & (F.col("key") == F.col("rkey")), "left")
    n = F.char_length("text") - F.char_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    # Every position takes part in one set operation: the work stays linear in the lines of a text.
    split = rows.select("id", "text", "dropped", n.cast("bigint").alias("n_lines"), F.when(F.col("dropped").isNotNull(), F.split("text", "\n", -1)).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped")
    kept = F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")
    return split.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"), F.coalesce(F.when(F.col("dropped").isNotNull(), kept), "text").alias("text"))
