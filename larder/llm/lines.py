"""Quality rules: measures of each text, and lines that too many documents of one host share.

Normalised lines are hashed; the distinct texts that hold a line are counted per host.  Lines above the limit, which grows
with the host, are boilerplate: they are taken out, and a document that keeps too little of its text is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, ragged_arange, slices, written

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
REPEAT_WORDS = 5
# A line is normalised: lower case, digits as one 0, white space runs as one blank.
_DIGITS = re.compile(r"\d+")


def repeated_words(counts: np.ndarray, words: np.ndarray, size: int = REPEAT_WORDS) -> np.ndarray:
    """Per row: words that lie in a window of `size` words found twice or more in the row.  words: 64-bit word hashes."""
    windows = np.maximum(counts - size + 1, 0)
    row = np.repeat(np.arange(len(counts)), windows)
    at = (np.cumsum(counts) - counts)[row] + ragged_arange(windows)
    if not len(at):
        return np.zeros(len(counts), np.int64)
    value = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            value = mix64(value * np.uint64(0x100000001B3) ^ words[at + k])
        value = value ^ mix64(row.astype(np.uint64))  # windows of different rows never match
    order = np.argsort(value)
    ordered = value[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(len(at), bool)
    hit[order] = twice
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at[hit], 1)
    np.add.at(edge, at[hit] + size, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(np.repeat(np.arange(len(counts)), counts), covered, len(counts)).astype(np.int64)


def measure(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of docs: id, host, key (a hash of the text), the measures, and per distinct normalised line its hash and characters in the text."""
    schema = "id bigint, host string, key bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, lines array<struct<line:bigint,chars:int>>"

    def run(batches):
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column(3).to_pylist()]
            split = [t.encode().split() for t in texts]  # bytes split at ASCII white space only
            counts = np.array([len(w) for w in split], np.int64)
            words = np.fromiter((hash(w) for row in split for w in row), np.int64, int(counts.sum())).view(np.uint64)
            chars = [len(t) - sum(map(t.count, SPACES)) for t in texts]
            symbols = [sum(map(t.count, SYMBOLS)) for t in texts]
            dups, lines = [], []
            for t in texts:
                full = [x for x in t.split("\n") if x.strip(SPACES)]
                dups.append(len(full) - len(set(full)))
                sizes: dict[str, int] = {}
                for x in full:
                    norm = _DIGITS.sub("0", " ".join(x.lower().split()))
                    sizes[norm] = sizes.get(norm, 0) + len(x)
                lines.append(sizes)
            table = {"line": [x for s in lines for x in s], "chars": [n for s in lines for n in s.values()]}
            ends = np.concatenate([[0], np.cumsum([len(s) for s in lines])])
            inner = pa.StructArray.from_arrays([pa.array(_line_hashes(table["line"])), pa.array(table["chars"], pa.int32())], names=["line", "chars"])
            columns = [counts, np.array(chars, np.int64), np.array(symbols, np.int64), np.array(dups, np.int64), repeated_words(counts, words)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *map(pa.array, columns), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner)], names=["id", "host", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"), F.xxhash64(text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema)


def _line_hashes(lines: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines)).view(np.int64)


def quality(docs: DataFrame, *, line_limit: int = 20, line_share: float = 0.05, least_left: float = 0.3, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_boilerplate_chars, kept.

    A line is boilerplate on a host if more than line_limit distinct texts of that host and more than line_share of them
    all hold it; a document is rejected if less than least_left of its lines' characters remain, or if the base rules
    fail.  Exact copies count once, whatever their ids; a null host is a host of its own; null, empty and wordless texts
    fail the base rules, null ids and repeated rows are judged like others; an empty table gives no row; other columns are
    not read.
    """
    measured = written(measure(docs, id_col=id_col, text_col=text_col, host_col=host_col), "measured")
    texts = measured.groupBy("host", "key").agg(F.count("*").alias("rows")).groupBy("host").agg(F.count("*").alias("texts"))
    limits = written(texts.select("host", F.greatest(F.lit(float(line_limit)), F.lit(line_share) * F.col("texts")).alias("limit")), "limits")
    held = measured.select("key", "host", F.explode("lines").alias("l")).select("key", "host", "l.line", "l.chars")
    counted = held.groupBy("host", "line").agg(F.count("*").alias("rows"), F.min("key").alias("a"), F.max("key").alias("b")).where((F.col("rows") > line_limit) & (F.col("a") != F.col("b")))
    frequent = written(counted.join(limits, "host").where(F.col("rows") > F.col("limit")).select("host", "line", "limit"), "frequent")
    # Only lines that pass as rows need the exact count of distinct texts; repeated texts are taken out first.
    distinct = written(held.join(frequent, ["host", "line"]).distinct(), "frequent-lines")
    above = distinct.groupBy("host", "line", "limit").agg(F.count("*").alias("texts")).where(F.col("texts") > F.col("limit")).select("host", "line")
    removed = distinct.join(above, ["host", "line"], "left_semi").groupBy("key", "host").agg(F.sum("chars").alias("gone"))
    whole = F.aggregate("lines", F.lit(0).cast("bigint"), lambda s, x: s + x["chars"])
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = measured.withColumn("whole", whole).drop("lines").join(removed.withColumnsRenamed({"key": "rkey", "host": "rhost"}), (F.col("key") == F.col("rkey")) & (F.col("host") == F.col("rhost")), "left")
    gone = F.coalesce("gone", F.lit(0))
    left = F.col("whole") - gone
    return rows.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), gone.cast("bigint").alias("n_boilerplate_chars"), (~base & ((gone == 0) | (left >= F.lit(least_left) * F.col("whole")))).alias("kept"))
