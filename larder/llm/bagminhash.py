"""Near-duplicate groups by BagMinHash: weighted-Jaccard signatures, banding, multiset verification, components.

A document is the multiset of its five-word shingles.  A shingle of weight w owns the weight levels [0, w).  The levels
are split into dyadic intervals [0,1), [1,2), [2,4), ...; each interval carries a Poisson process in time whose points
have a uniform level and a uniform signature slot.  A signature slot keeps the earliest point below the shingle's weight,
so two slots agree with a chance equal to the weighted Jaccard similarity.  Points later than the slowest slot never
matter; they are not generated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, list_parts, mix64, ragged_arange, slices, written

WORDS = "[^\\p{L}\\p{M}\\p{N}]+"
SHINGLE = 5
BANDS, ROWS = 24, 5
ROUNDS = 3
SMALL_BUCKET = 40
ROWS_A_TASK = 20_000
BROADCAST_IDS = 500_000
#: Rows signed together: each needs some 900 points of the processes, whatever its length.
BLOCK_ROWS = 250
SLOTS = BANDS * ROWS
#: Parts of the items' range in which a bag's items are counted; a bag with more than MOST in one of them has no counts.
CELLS, MOST = 256, 127
_U = np.uint64


def shingle_bags(offsets: np.ndarray, words: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight) of every distinct shingle of every row, in row order.

    offsets and words: the rows' word hashes.  A row with fewer words than `size` has one shingle of all its words.
    """
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), count)
    at = offsets[:-1][row] + ragged_arange(count)
    length = np.minimum(n[row], size)
    value = np.full(len(at), 0x9E3779B97F4A7C15, _U)
    flat = words.astype(np.int64).view(_U)
    with np.errstate(over="ignore"):
        for k in range(size):
            inside = k < length
            value[inside] = mix64(value[inside] * _U(0x100000001B3) ^ flat[at[inside] + k])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return row[first], value[first], np.diff(np.append(first, len(row)))


def signatures(n_rows: int, row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures (n_rows, slots) of 24-bit values; rows without shingles get zeros.  row ascends.

    A row's slots are all filled by points up to about slots * (ln slots + c) / total weight.  Points are made up to
    such a bound; rows with an empty slot are done again with a larger one.  A slot, a point's time (20 bits of its
    floating form) and its identity are packed into one word, so that a plain sort brings each slot's earliest point
    first; equal times fall back on the identity, alike in every document.
    """
    out = np.zeros((n_rows, slots), np.uint32)
    for begin in range(0, n_rows, BLOCK_ROWS):
        end = min(n_rows, begin + BLOCK_ROWS)
        lo, hi = np.searchsorted(row, [begin, end])
        _sign_block(out[begin:end], row[lo:hi] - begin, shingle[lo:hi], weight[lo:hi])
    return out


def _sign_block(out, row, shingle, weight) -> None:
    n_rows, slots = out.shape
    total = np.bincount(row, weight, n_rows)
    slack, todo = 3.0, total > 0
    while todo.any():
        use = slice(None) if todo.all() else todo[row]
        time, slot, ident, owner = _points(row[use], shingle[use], weight[use], slots * (math.log(slots) + slack) / np.maximum(total, 1))
        when = (np.clip(time, 2.0**-40, 2.0**23).view(_U) >> _U(38)) - _U((1023 - 40) << 14)  # monotonous in time
        packed = np.sort(((owner * slots + slot).astype(_U) << _U(44)) | (when << _U(24)) | ident)
        place = packed >> _U(44)
        first = np.ones(len(place), bool)
        first[1:] = place[1:] != place[:-1]
        place, ident = place[first].astype(np.int64), (packed[first] & _U(0xFFFFFF)).astype(np.uint32)
        full = np.bincount(place // slots, minlength=n_rows) == slots
        done = full[place // slots]
        out.ravel()[place[done]] = ident[done]
        todo &= ~full
        slack = slack * 2 + 4


def _points(row, shingle, weight, until) -> tuple[np.ndarray, ...]:
    """Every process's points up to its row's time `until`, kept below the shingle's weight: time, slot, identity, row."""
    heavy = np.flatnonzero(weight > 1)
    levels = np.ceil(np.log2(weight[heavy])).astype(np.int64)  # dyadic intervals that begin below the weight, besides the first
    at = np.concatenate([np.arange(len(row)), np.repeat(heavy, levels)])
    j = np.concatenate([np.zeros(len(row), np.int64), ragged_arange(levels) + 1])
    rate = np.where(j == 0, 1.0, np.exp2(j - 1.0))  # an interval's width; its lower end too, but for the first
    low = np.where(j == 0, 0.0, rate)
    state = mix64(shingle[at] + _U(0x2545F4914F6CDD1D) * (j + 1).astype(_U))
    own, most, limit = row[at], weight[at].astype(float), until[row[at]]
    time = np.zeros(len(at))
    found = []
    while len(state):
        a = mix64(state + _U(0x9E3779B97F4A7C15))
        time = time - np.log(((a >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        live = time <= limit
        state, time, rate, low, own, most, limit, a = (x[live] for x in (a, time, rate, low, own, most, limit, a))
        b = mix64(a ^ _U(0xD1B54A32D192ED03))
        keep = low + rate * ((b >> _U(40)).astype(np.float64) * 2.0**-24) < most  # slot, identity and level: bits 0-15, 16-39, 40-63
        b = b[keep]
        found.append((time[keep], ((b & _U(0xFFFF)) * _U(SLOTS) >> _U(16)).astype(np.int64), (b >> _U(16)) & _U(0xFFFFFF), own[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, np.int64))


def _word_hashes(text_col: str):
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WORDS), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _node(words: str | Column) -> Column:
    """A text's name: a 64-bit hash of all its words."""
    return F.xxhash64(words)


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, id, total, sig) of every row: the row's id, its text's name, its multiset size, and the signature as slot-tagged 32-bit words."""
    schema = "doc bigint, id bigint, total bigint, sig array<int>"

    def run(batches):
        for part in slices(batches, "words", 6 << 17):
            offsets, words = list_parts(part.column(2))
            row, value, weight = shingle_bags(offsets, words)
            sig = signatures(part.num_rows, row, value, weight)
            tag = (np.arange(SLOTS, dtype=np.int64) << 24)[None, :] | sig.astype(np.int64)  # eight bits of slot, 24 of value
            tag = tag.astype(np.uint32).view(np.int32)
            total = np.bincount(row, weight, part.num_rows).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * SLOTS, pa.int32()), pa.array(tag.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(total), lists], names=["doc", "id", "total", "sig"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), _word_hashes(text_col).alias("words"))
    return rows.select("doc", _node("words").alias("id"), "words").mapInArrow(run, schema)


def _bags(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """(id, n, cells, bag) of the wanted texts (doc, id), each read from the row of that doc: a shingle's n-th copy is an item of its own, so that bags intersect as sets.

    n: the bag's items; cells: how many lie in each of CELLS equal parts of the items' range (null where a count is above MOST).
    """

    def run(batches):
        for part in slices(batches, "words", 6 << 17):
            part = part.filter(pc.equal(part.column(0), part.column(1)))
            offsets, words = list_parts(part.column(2))
            row, value, weight = shingle_bags(offsets, words)
            items = mix64(np.repeat(value, weight) + ragged_arange(weight).astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)
            n = np.bincount(row, weight, part.num_rows).astype(np.int64)
            bags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(items))
            place = np.repeat(np.arange(part.num_rows) * CELLS, n) + (items.view(_U) >> _U(56)).astype(np.int64)
            cells = np.bincount(place, minlength=part.num_rows * CELLS)
            full = cells.reshape(-1, CELLS).max(axis=1, initial=0) > MOST
            cells = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * CELLS, pa.int32()), pa.array(np.minimum(cells, MOST).astype(np.int8)), mask=pa.array(full))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), cells, bags], names=["id", "n", "cells", "bag"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    rows = rows.join(_small(wanted), "doc").select("id", _word_hashes("text").alias("words")).select("id", _node("words").alias("node"), "words")
    return rows.mapInArrow(run, "id bigint, n int, cells array<tinyint>, bag array<bigint>")


def _once(df: DataFrame, name: str, parts: int | None = None, keys: Sequence[str] = ("id",)) -> DataFrame:
    """df written, with one row for each key.  Only rows whose key repeats are shuffled."""
    table = written(df, name, parts)
    again = table.groupBy(*keys).count().where("count > 1").drop("count")
    if again.isEmpty():
        return table
    again = written(again, f"{name}-again")
    few = table.join(again, list(keys), "left_semi").dropDuplicates(list(keys))
    return _replaced(table.join(_small(again), list(keys), "left_anti").unionByName(few), f"{name}-once", parts, table, again)


def components(edges: DataFrame, name: str, parts: int) -> DataFrame:
    """(id, root) of every vertex of undirected edges (a, b): root is the least id of its component.

    Alternating large-star and small-star steps; a hub's neighbours are never gathered, only minima are aggregated.
    parts: tasks that the small tables of ids are worth.
    """
    pairs = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0", parts)
    step, before = 0, None
    while True:
        step += 1
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = written(low.select("a", F.least("m", "a").alias("m")), f"{name}-low-{step}", parts)  # a written side lets Spark split a hub's rows in the join
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts)
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(parts)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        after = written(small, f"{name}-{step}", parts)
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30)), F.sum(F.xxhash64("b", "a") % (1 << 30))).first()  # of the set of pairs
        same, before = now == before, now
        drop_written(pairs)
        drop_written(low)
        pairs = after
        if same:
            roots = pairs.select(F.col("a").alias("id"), F.col("b").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("id"), "root").distinct())


def _regrouped(roots: DataFrame, fresh: DataFrame, name: str, parts: int) -> DataFrame:
    """The (id, root) of components(), written, after edges `fresh` have come to those of `roots`.

    Only the fresh edges are gone through, as edges between roots; a vertex without a root is its own.
    """
    x, y = (roots.select(F.col("id").alias(c), F.col("root").alias(f"root{c}")) for c in "ab")
    edges = fresh.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("roota", "a").alias("a"), F.coalesce("rootb", "b").alias("b"))
    moved = components(edges, f"{name}-moved", parts)
    moved = _replaced(moved, f"{name}-new", parts, moved)
    to = moved.select(F.col("id").alias("root"), F.col("root").alias("to"))
    rows = roots.join(_small(to), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return _replaced(rows.unionByName(moved.join(roots, "id", "left_anti")), name, parts, roots, moved)


def _within(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Drops pairs (a, b) whose bags cannot overlap by `threshold`: in a cell they share the smaller count at most."""
    x, y = (bags.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("cells").alias(f"c{c}")) for c in "ab")
    rows = pairs.join(x, "a").join(y, "b").where(F.least("na", "nb") >= F.lit(threshold - 1e-12) * F.greatest("na", "nb"))
    most = F.aggregate(F.zip_with("ca", "cb", lambda i, k: F.least(i, k)), F.lit(0), lambda total, i: total + i)
    most = F.coalesce(most, F.least("na", "nb"))
    return rows.where(most >= F.lit(threshold - 1e-12) * (F.col("na") + F.col("nb") - most)).select("a", "b")


def _similar(pairs: DataFrame, bags: DataFrame, threshold: float, name: str, parts: int) -> DataFrame:
    """The pairs (a, b), written, whose bags have a weighted Jaccard similarity of at least `threshold`.

    Counts are compared first, and bags move only for the pairs that these leave.
    """
    near = written(_within(pairs, bags, threshold), f"{name}-near", parts)
    ids = written(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids", parts)
    held = bags.join(_small(ids), "id", "left_semi")
    rows = near.join(held.select(F.col("id").alias("a"), F.col("bag").alias("x")), "a").join(held.select(F.col("id").alias("b"), F.col("bag").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    rows = rows.where(common >= F.lit(threshold - 1e-12) * (F.size("x") + F.size("y") - common))
    return _replaced(rows.select("a", "b"), name, parts, near, ids)


def _classes(docs: DataFrame, *, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (doc, id, total) of every row, and (id, rep, class_id, n_links) of every text with a word, written.

    id is a text's name, rep the least doc of its rows, class_id the least doc of the class.
    """
    signed = written(sign(docs, id_col, text_col), "signed")
    parts = max(8, -(-signed.count() // ROWS_A_TASK))
    texts = written(signed.where("total > 0 and doc is not null").groupBy("id").agg(F.min("doc").alias("rep")), "texts", parts)
    reps = signed.join(_small(texts), "id").where("doc = rep").select("id", "rep", "total", "sig")
    reps = _once(reps, "reps", parts)
    rows = _replaced(signed.select("doc", "id", "total"), "rows", parts, signed)

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(k, F.slice("sig", k * ROWS + 1, ROWS)))
    keys = reps.select("id", F.explode(bands).alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared", parts)
    keys = _replaced(keys.join(_small(shared), "key"), "keys", parts, shared)
    # Signatures are held against each other in every round: only those of texts that share a bucket stay.
    known = written(keys.select("id").distinct(), "known", parts)
    reps = _replaced(reps.join(_small(known), "id", "left_semi"), "signatures", parts, reps, known)
    wanted = written(reps.select(F.col("rep").alias("doc"), "id"), "wanted", parts)
    placed = _replaced(keys.join(reps.select("id", "rep", "total"), "id"), "placed", parts, keys)
    bags = _once(_bags(docs, id_col, text_col, wanted), "bags")

    links, roots = None, placed.select("id", F.col("id").alias("root")).limit(0)
    for n in range(ROUNDS):
        mixed = placed if n == 0 else _mixed(placed, roots, n, parts)
        if n and (mixed.groupBy("key").count().agg(F.max("count")).first()[0] or 0) <= SMALL_BUCKET:
            break
        order = [F.struct("rep", "id"), F.struct("total", "rep", "id")][n] if n < 2 else F.struct(F.xxhash64("id", F.lit(n)), "id")
        leads = written(mixed.groupBy("key").agg(F.min_by(F.struct("id", "total", *([] if n == 0 else ["root"])), order).alias("lead")), f"leads-{n}", parts)
        pairs = mixed.join(leads, "key").where("id <> lead.id" if n == 0 else "root <> lead.root").where(_near_sizes("total", "lead.total", threshold)).select(F.greatest("id", "lead.id").alias("a"), F.least("id", "lead.id").alias("b")).distinct().coalesce(parts)
        likely = written(_plausible(pairs, reps, threshold), f"likely-{n}", parts)
        fresh = _similar(likely, bags, threshold, f"links-{n}", parts)
        for t in (likely, leads):
            drop_written(t)
        if n and fresh.isEmpty():
            break
        roots = components(fresh, f"roots-{n}", parts) if n == 0 else _regrouped(roots, fresh, f"roots-{n}", parts)
        links = fresh if links is None else _replaced(links.unionByName(fresh), f"all-links-{n}", parts, links, fresh)
    rest = written(_mixed(placed, roots, ROUNDS, parts).select("id", "root").distinct(), "rest", parts)
    if not rest.isEmpty():
        fresh = _across_classes(bags, rest, threshold, parts)
        roots = _regrouped(roots, fresh, "all-roots", parts)
        links = _replaced(links.unionByName(fresh), "all-links", parts, links, fresh)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
    named = written(texts.join(roots, "id").groupBy("root").agg(F.min("rep").alias("class_id")), "named", parts)
    joined = roots.join(named, "root").join(degree, "id").select("id", "class_id", "n_links")
    classes = texts.join(joined, "id", "left").select("id", "rep", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    classes = written(classes, "classes", parts)
    for t in (reps, placed, wanted, bags, rest, texts, links, roots, named):
        drop_written(t)
    return rows, classes


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """(id, class_id, n_links) of every row; class_id is the least id of the near-duplicate class, n_links the links of its text that were verified (stars and cross-class links, not all similar pairs).

    Rows with the same words form one text first; no pairs are made among them.  Distinct texts are linked where their
    five-word multisets overlap by `threshold` or more, found by banding and verified exactly:
    1. in a few rounds every text of a bucket is held against one leader of the bucket (a star, not all pairs), another
       leader in each round, as long as buckets of more than SMALL_BUCKET texts still have several classes;
    2. texts that a bucket then still leaves in several classes are joined exactly, and only across classes, on the rarest
       of the shingles that lie in several classes (two bags that overlap by the threshold share one of these).
    Signatures choose candidates only in step 1 (bands, and six standard deviations of agreeing slots).
    Null, empty and wordless texts are classes of their own; a null id keeps a null class.  Ids are integers; repeated rows
    get equal results, and different texts under one id are texts of their own.  An empty table gives no row; other columns
    are not read.
    """
    rows, classes = _classes(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    kind = docs.schema[id_col].dataType
    found = rows.join(classes.drop("rep"), "id", "left")
    return found.select(F.col("doc").cast(kind).alias(id_col), F.when(F.col("total") > 0, F.coalesce("class_id", "doc")).otherwise(F.col("doc")).cast(kind).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _small(ids: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if it is small; larger ones are shuffled."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _replaced(df: DataFrame, name: str, parts: int, *old: DataFrame) -> DataFrame:
    """df written; the tables it was made of are deleted."""
    out = written(df, name, parts)
    for t in old:
        drop_written(t)
    return out


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of docs that name their near-duplicate class (the least id), columns unchanged.

    Of rows that repeat both id and words one stays; rows with a null id, and null, empty or wordless texts all stay.  An
    empty table stays empty.  Whole rows are shuffled only if more ids go than may be broadcast, or repeat.
    """
    rows, classes = _classes(docs, id_col=id_col, text_col=text_col, threshold=threshold)
    full = rows.where("doc is not null and total > 0")
    again = written(full.groupBy("doc").count().where("count > 1").select("doc"), "again")
    stays = written(full.join(classes, "id").where("doc = class_id and rep = class_id").select("doc", "id").distinct(), "stays")
    goes = full.join(stays.select("doc", F.lit(1).alias("__stays")), "doc", "left").where("__stays IS NULL").select("doc").distinct()
    if again.isEmpty():
        return docs.join(_small(written(goes, "goes")), F.col(id_col).cast("bigint") == F.col("doc"), "left_anti")
    # Ids that repeat are settled by id and words; one row of each that stays is told apart by a dropDuplicates among them alone.
    goes = written(goes.unionByName(again).distinct(), "goes")
    single = docs.join(_small(goes), F.col(id_col).cast("bigint") == F.col("doc"), "left_anti")
    words = _word_hashes(text_col)
    odd = docs.withColumn("__doc", F.col(id_col).cast("bigint")).join(_small(again), F.col("__doc") == F.col("doc"), "left_semi").withColumn("__words", words).withColumn("__id", _node("__words"))
    odd = odd.join(stays.select(F.col("doc").alias("__doc"), F.col("id").alias("__id")), ["__doc", "__id"], "left_semi").dropDuplicates(["__doc", "__id"])
    bare = docs.join(_small(again), F.col(id_col).cast("bigint") == F.col("doc"), "left_semi").where(F.size(words) == 0)
    return single.unionByName(odd.select(*docs.columns)).unionByName(bare)


def _near_sizes(x: str, y: str, threshold: float) -> Column:
    return F.least(x, y) >= F.lit(threshold) * F.greatest(x, y)


def _plausible(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Drops pairs whose sizes rule the threshold out, or whose signatures agree in six standard deviations fewer slots than it implies."""
    least = math.floor(SLOTS * threshold - 6 * math.sqrt(SLOTS * threshold * (1 - threshold)))
    x, y = (reps.select(F.col("id").alias(c), F.col("total").alias(f"t{c}"), F.col("sig").alias(f"s{c}")) for c in "ab")
    rows = pairs.join(x, "a").join(y, "b").where(_near_sizes("ta", "tb", threshold))
    return rows.where(F.size(F.array_intersect("sa", "sb")) >= least).select("a", "b")


def _mixed(placed: DataFrame, roots: DataFrame, n: int, parts: int) -> DataFrame:
    """The rows of `placed`, with their class, that are in buckets of several classes."""
    rows = placed.join(roots, "id", "left").select("key", "id", "rep", "total", F.coalesce("root", "id").alias("root"))
    mixed = written(rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key"), f"mixed-{n}", parts)
    return rows.join(mixed, "key")


def _across_classes(bags: DataFrame, rest: DataFrame, threshold: float, parts: int) -> DataFrame:
    """Verified links between texts of `rest` in different classes, by an exact prefix and position filter.

    Only items that lie in several classes can link them.  Every bag is sorted: first its other items, then these, rare ones
    first; one order for all.  Bags of n and m items that overlap by the threshold share at least o = t (n + m) / (1 + t)
    items, and so one of the first n - o + 1 and m - o + 1; and where the first shared item stands at i and j, they share
    min(n - i, m - j) items at most.  Sizes are put into steps of ratio 1 / t, so that a bag has three steps of partners, and
    gives each step only the items that o allows for it; a bag with so many other items that none is left is not gathered.
    """
    t = threshold
    held = bags.join(_small(rest), "id")
    items = held.select("id", "root", F.explode("bag").alias("item"))
    common = items.groupBy("item").agg(F.count("*").alias("count"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("item", "count")
    common = written(common, "common", parts)
    pool = _replaced(items.select("id", "item").join(_small(common), "item"), "pool", parts, common)
    tally = written(pool.groupBy("id").agg(F.count("*").cast("int").alias("n_shared")), "tally", parts)
    rows = tally.join(held.select("id", "root", "n"), "id").withColumn("own", F.col("n") - F.col("n_shared")).drop("n_shared")

    def step(n: Column) -> Column:
        return F.floor(F.log(n) / F.lit(-math.log(t)) + 1e-9).cast("int")

    rows = rows.withColumn("step", step(F.col("n")))
    rows = rows.withColumn("to", F.explode(F.array(*[F.col("step") + k for k in (-1, 0, 1)])))
    smallest = F.greatest(F.pow(F.lit(1 / t), F.col("to")) - 1e-6, t * F.col("n"))  # the least size of a partner in that step
    first = F.col("n") - F.ceil(t / (1 + t) * (F.col("n") + smallest) - 1e-6) + 1 - F.col("own")
    short = written(rows.withColumn("first", first.cast("int")).where("first > 0").select("id", "root", "n", "own", "step", "to", "first"), "short", parts)
    few = written(short.select("id").distinct(), "few", parts)
    ranked = pool.join(_small(few), "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("count", "item"))).alias("shared"))
    heads = short.join(ranked, "id").select("id", "root", "n", "own", "step", "to", F.posexplode(F.slice("shared", F.lit(1), F.col("first"))).alias("k", "x"))
    heads = heads.select("id", "root", "n", "step", "to", (F.col("own") + F.col("k")).alias("at"), F.col("x.item").alias("item"))
    heads = _replaced(heads, "heads", parts, pool, tally, short, few)
    x = heads.select("item", "step", "to", *[F.col(c).alias(f"{c}a") for c in ("id", "root", "n", "at")])
    y = heads.select("item", F.col("to").alias("step"), F.col("step").alias("to"), *[F.col(c).alias(f"{c}b") for c in ("id", "root", "n", "at")])
    most = F.least(F.col("na") - F.col("ata"), F.col("nb") - F.col("atb"))
    fits = (F.col("roota") < F.col("rootb")) & (most >= F.lit(t / (1 + t) - 1e-9) * (F.col("na") + F.col("nb")))
    pairs = x.join(y, ["item", "step", "to"]).where(fits).select(F.greatest("ida", "idb").alias("a"), F.least("ida", "idb").alias("b")).distinct()
    pairs = _replaced(pairs, "across", parts, heads)
    links = _similar(pairs, bags, threshold, "across-links", parts)
    drop_written(pairs)
    return links
