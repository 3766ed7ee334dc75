"""Alignment of two public tokenizers over the same bytes.

Both tokenizers report where their tokens lie: one in characters, the other in bytes of its protobuf spans.  These are the
coarse cuts; tokens that end within a character, and byte-fallback tokens, are placed by the bytes they decode to.  Offsets
where tokens of both end cut a text into groups; tokens whose byte ranges overlap are linked.

Neither tokenizer lets a token reach across a single blank or line feed between two words, nor across a comma or full stop
after a letter (the vocabulary is asked), so texts are cut there, and each Python worker aligns equal pieces once.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ragged_arange, slices, written

CUT = re.compile(r"(?<=\S)(?:( )|(\n))(?=\S)")
#: A comma or full stop that closes a word but does not follow a Latin letter: such a text is not cut before them.
ODD_END = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ɏ][,.](?=[ \n]|\Z)")
PLAIN = re.compile(r" ?\S")
BLANK = "▁"
MEMO_PIECES = 300_000
LEARN_TOGETHER = 512
CHUNK_CHARS = 1 << 20
#: The most pairs that are sent to every executor: those that are more than such a share of all rows.
HOT_PAIRS = 100_000


def byte_level_bytes(tokenizer: Tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the others, in order, for the next from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    byte_of = {chr(b if b in shown else next(rest)): bytes([b]) for b in range(256)}
    return [b"".join(byte_of.get(c, c.encode()) for c in tokenizer.id_to_token(i) or "") for i in range(tokenizer.get_vocab_size())]


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each id of a piece vocabulary: the blank mark is a blank, <0xHH> the byte HH."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(BLANK, " ").encode() for i in range(model.get_piece_size())]


def _merged(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union and the intersection of two strictly rising arrays."""
    every = np.sort(np.concatenate([x, y]), kind="stable")
    twice = every[1:] == every[:-1]
    return every[np.append(~twice, True)], every[1:][twice]


def _holds(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values a rising array holds."""
    if not len(x):
        return np.zeros(len(values), bool)
    return x[np.minimum(np.searchsorted(x, values), len(x) - 1)] == values


def _strings(n: int) -> np.ndarray:
    return np.array([str(i) for i in range(n)], object)


class Aligner:
    """Groups and links of texts, through a memo of pieces.  A text is seen as one blank and the text."""

    def __init__(self, path_a: str, path_b: str):
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = byte_level_bytes(self.a), piece_bytes(self.b)
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.falls_back = np.array([self.b.is_byte(i) for i in range(len(self.bytes_b))])
        self.shown = _strings(max(len(self.bytes_a), len(self.bytes_b)))
        pieces = [self.b.id_to_piece(i) for i in range(len(self.bytes_b))]
        self.cuts_blanks = not any(BLANK in p.lstrip(BLANK) or ("\n" in p and len(p) > 1) for p in pieces)
        self.cuts_ends = not any(x.isalpha() and y in ",." for p in pieces for x, y in zip(p, p[1:], strict=False))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.texts: list[str] = []
        self.fresh: list[tuple] = []
        self.counts = np.zeros((0, 4), np.int64)  # valid, tokens of a, tokens of b, groups
        self.start = self.size = self.uses = self.links = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps pieces met more than once, the most used half of a full memo at most; their counts are halved."""
        least = 2
        while (keep := np.flatnonzero(self.uses >= least)).size > MEMO_PIECES // 2:
            least *= 2
        names, size = list(self.index), self.size[keep]
        self.links = self.links[np.repeat(self.start[keep], size) + ragged_arange(size)]
        self.index = {names[i]: k for k, i in enumerate(keep.tolist())}
        self.texts = [self.texts[i] for i in keep.tolist()]
        self.counts, self.start, self.size, self.uses = self.counts[keep], np.cumsum(size) - size, size, (self.uses[keep] + 1) // 2

    def spans(self, text: str, fresh: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids, byte ends) of both tokenizers over a text; None if either one's bytes are not the text's.

        fresh: the text begins with a line feed, before which the second tokenizer puts a blank of its own; it is left out.
        """
        data = text.encode()
        found = self.a.encode(text, add_special_tokens=False)
        a, stop = np.array(found.ids, np.int64), np.fromiter(chain.from_iterable(found.offsets), np.int64)[1::2]
        pieces = self.b.encode(text if fresh else "\n" + text, return_type="proto").pieces
        lead = 1 if fresh else 2
        b, end_b = np.array([(p.id, p.end) for p in pieces], np.int64)[lead:].T
        end_b = end_b + (1 - lead)
        if b"".join(map(self.bytes_a.__getitem__, a.tolist())) != data or b"".join(map(self.bytes_b.__getitem__, b.tolist())) != data:
            return None
        if len(data) > len(text):  # characters of several bytes: a token that ends within one is cut there
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)
            coarse, exact = np.concatenate([[0], np.cumsum(width)])[stop], np.cumsum(self.size_a[a])
            stop = np.where(exact < coarse, exact, coarse)
        fallback = self.falls_back[b]
        if fallback.any():
            end_b = np.where(fallback, np.cumsum(self.size_b[b]), end_b)
        return a, stop, b, end_b

    def _learn(self, pieces: list[str], fresh: bool) -> None:
        """Adds the pieces; fresh: they are put together with line feeds between and around them."""
        text = "\n" + "\n".join(pieces) + "\n" if fresh else pieces[0]
        spans = self.spans(text, fresh)
        # Ends of the stretches of the text: line feed, piece, line feed, ..., or the one piece.
        sizes = np.array([len(p.encode()) for p in pieces], np.int64)
        stretch = np.ones(2 * len(pieces) + 1, np.int64) if fresh else sizes
        if fresh:
            stretch[1::2] = sizes
        ends = np.cumsum(stretch)
        segments, both = _merged(spans[1], spans[3]) if spans else (ends, ends[:0])
        if fresh and not _holds(both, ends).all():  # one of them is not the tokenizers' own: each by itself
            for p in pieces:
                self._learn([p], False)
            return
        if not spans:
            self._add(pieces, np.zeros((1, 4), np.int64), [""], np.zeros(1, np.int64), np.zeros(0, np.int64))
            return
        a, end_a, b, end_b = spans
        # Each segment is the overlap of one token of a and one of b.
        links = a[np.searchsorted(end_a, segments)] << 32 | b[np.searchsorted(end_b, segments)]
        per = [np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (end_a, end_b, both, segments)]
        # Tokens by group, those of a first; each is followed by what stands between it and the next.
        key = np.concatenate([2 * np.searchsorted(both, end_a), 2 * np.searchsorted(both, end_b) + 1])
        order = np.argsort(key, kind="stable")
        key, kind = key[order], key[order] & 1
        last = np.append(key[1:] != key[:-1], True)
        closes = _holds(ends, both)[key >> 1]
        mark = np.where(~last, ",", np.where(kind == 0, "|", np.where(closes, "\n", ";"))).astype(object)
        parts = np.empty(2 * len(order), object)
        parts[0::2], parts[1::2] = self.shown[np.concatenate([a, b])[order]], mark
        texts = "".join(parts.tolist()).split("\n")[:-1]
        own = slice(1, None, 2) if fresh else slice(None)
        counts = np.column_stack([np.ones(len(pieces), np.int64), *[x[own] for x in per[:3]]])
        if fresh:
            starts = np.cumsum(per[3]) - per[3]
            links = links[np.repeat(starts[own], per[3][own]) + ragged_arange(per[3][own])]
        self._add(pieces, counts, texts[own], per[3][own], links)

    def _add(self, pieces: list[str], counts: np.ndarray, texts: list[str], size: np.ndarray, links: np.ndarray) -> None:
        for p in pieces:
            self.index[p] = len(self.index)
        self.texts += texts
        self.fresh.append((counts, size, links))

    def _gather(self) -> None:
        """Puts what has been learned into the arrays."""
        counts, size, links = (np.concatenate(x) for x in zip(*self.fresh, strict=True))
        self.fresh = []
        self.counts = np.concatenate([self.counts, counts])
        self.start = np.concatenate([self.start, len(self.links) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.links = np.concatenate([self.links, links])
        self.uses = np.concatenate([self.uses, np.zeros(len(size), np.int64)])

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text that begins with a blank or a line feed."""
        if not self.cuts_blanks:
            return [text]
        if "\0" not in text and text[1:].replace("\n", " ").split(" ") == text.split():
            cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
            if self.cuts_ends and not ODD_END.search(text):
                cut = cut.replace(",\0", "\0,\0").replace(".\0", "\0.\0")
                cut = cut[:-1] + "\0" + cut[-1] if cut[-1] in ",." else cut
            return cut[1:].split("\0")
        out, at = [], 0
        for m in CUT.finditer(text):
            if m.start() > at:
                out.append(text[at : m.start()])
            at = m.start()
            if m.group(2):
                out.append("\n")
                at += 1
        return [*out, text[at:]]

    def chunks(self, text: str) -> list[str]:
        """A long text cut at places where no token lies across, so that its pieces never are in memory all at once."""
        out, at = [], 0
        while self.cuts_blanks and len(text) - at > CHUNK_CHARS and (m := CUT.search(text, at + CHUNK_CHARS)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def align(self, texts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """For each text (tokens of a, tokens of b, groups, links), the digest of the groups, and the linked id pairs with how often each is.

        Texts go through the memo some together, so that their new pieces are learned at once.
        """
        out, digest, held = [], hashlib.sha256(), []
        totals, valid, found, times = np.zeros(4, np.int64), True, [], []

        def flush():
            nonlocal totals, valid, digest, found, times, held
            for (last, _), at in zip(held, self._numbers([pieces for _, pieces in held]), strict=True):
                counts = self.counts[at]
                valid = valid and bool(counts[:, 0].all())
                if valid and len(at):
                    digest.update((";" * bool(totals[0]) + ";".join(map(self.texts.__getitem__, at.tolist()))).encode())
                    size = self.size[at]
                    links = self.links[np.repeat(self.start[at], size) + ragged_arange(size)]
                    totals += [*counts[:, 1:].sum(axis=0), len(links)]
                    own, n = np.unique(links, return_counts=True)
                    found.append(own)
                    times.append(n)
                if last:
                    if not valid or not totals[0]:
                        out.append((np.zeros(4, np.int64), "", np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    elif len(found) > 1:
                        pairs, back = np.unique(np.concatenate(found), return_inverse=True)
                        out.append((totals, digest.hexdigest(), pairs, np.bincount(back, np.concatenate(times)).astype(np.int64)))
                    else:
                        out.append((totals, digest.hexdigest(), found[0], times[0]))
                    totals, valid, digest, found, times = np.zeros(4, np.int64), True, hashlib.sha256(), [], []
            held = []

        size = 0
        for text in texts:
            chunks = self.chunks(" " + text) if text else [""]
            for k, chunk in enumerate(chunks):
                held.append((k == len(chunks) - 1, self.pieces(chunk) if chunk else []))
                size += len(chunk)
                if size >= CHUNK_CHARS:
                    flush()
                    size = 0
        flush()
        return out

    def _numbers(self, rows: list[list[str]]) -> list[np.ndarray]:
        """The numbers of the pieces of each row, after learning those that are new."""
        fresh = {p: None for p in chain.from_iterable(rows) if p not in self.index}
        if fresh:
            if len(self.index) + len(fresh) > MEMO_PIECES and self.index:
                self._forget()
                fresh = {p: None for p in chain.from_iterable(rows) if p not in self.index}
            plain = [p for p in fresh if PLAIN.match(p) and p[-1:].strip()]
            for p in fresh.keys() - set(plain):
                self._learn([p], False)
            for k in range(0, len(plain), LEARN_TOGETHER):
                self._learn(plain[k : k + LEARN_TOGETHER], True)
            self._gather()
        counts = np.array([len(row) for row in rows], np.int64)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(rows)), np.int64, int(counts.sum()))
        self.uses += np.bincount(at, minlength=len(self.uses))
        return np.split(at, np.cumsum(counts)[:-1])


def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker: its memo outlives a task."""
    cache = sys.modules.setdefault("larder_worker_cache", types.ModuleType("larder_worker_cache")).__dict__.setdefault("aligners", {})
    if (path_a, path_b) not in cache:
        cache[path_a, path_b] = Aligner(path_a, path_b)
    return cache[path_a, path_b]


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups_sha256, and its linked id pairs (a * 2^32 + b) with how often each is, as arrays pairs and times."""
    schema = "id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>"

    def run(batches):
        aligner = worker_aligner(path_a, path_b)
        for part in slices(batches, "text", 1 << 20):
            totals, digests, pairs, times = zip(*aligner.align(part.column(1).to_pylist()), strict=True)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x), kind)) for x, kind in ((pairs, pa.int64()), (times, pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, np.array(totals).T), pa.array(digests), *lists], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best): how many rows hold each linked id pair, and whether no other pair of its first id is held by more."""
    counted = written(aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")), "pairs")
    most = counted.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("docs").alias("most"))
    return counted.withColumn("a", F.shiftright("pair", 32)).join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best counts links whose id pair is in as many rows as any pair of its first id; count_sum adds up, over links, in how
    many rows their pair is.  Pairs that are more than one in HOT_PAIRS of all (row, pair)s, which are HOT_PAIRS at most, go
    to every task; the others are joined by shuffling and are no hot keys.  Texts that are null or empty, or that a tokenizer
    does not give back byte for byte, have zeros and an empty digest; very long ones are taken piece by piece; repeated rows
    and null ids are rows like others; an empty table gives no row; other columns are not read.
    """
    rows = align(docs, path_a, path_b, id_col=id_col, text_col=text_col)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counted = written(pair_counts(rows), "pair-counts")
    total = counted.agg(F.sum("docs")).first()[0] or 0
    hot = F.col("docs") > total / HOT_PAIRS
    held = rows.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    found = held.join(F.broadcast(counted.where(hot)), "pair", "left")
    common = found.where("docs IS NOT NULL").select("row", "times", "docs", "best")
    others = found.where("docs IS NULL").select("row", "pair", "times").join(counted.where(~hot), "pair").select("row", "times", "docs", "best")
    sums = common.unionByName(others).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    whole = rows.drop("pairs", "times").join(sums, "row", "left")
    none = F.lit(0).cast("bigint")
    return whole.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
