"""Token ids of whole texts with a public tokenizer, through a memo of the pieces that recur.

Both vocabularies split a text before they merge anything, and never across a single blank or line feed that stands
between two other characters.  So a text may be cut there, equal pieces need the tokenizer only once, and the ids of
the pieces, put together, are those of the text.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import sys
import threading
import time
import types
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, pre_tokenizers

from .common import ragged_arange

CUT = re.compile(r"(?<=\S)(?:( )|(\n))(?=\S)")
MEMO_PIECES = 240_000
MEMO_CHARS = 48
MEMO_LONG_CHARS = 8 << 20
TOGETHER = 32
IDLE_SECONDS = 1
# Marks that end a word: both vocabularies make one of them after a letter a token of its own.
ENDINGS = ",."
#: What makes a text less than plain, besides blanks at its ends: zero characters, runs of blanks and line feeds, other white space.
ODD = ["\0", "  ", "\n\n", " \n", "\n ", *[c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]]


class _Numbers(dict):
    """Numbers new keys in their order."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class PieceEncoder:
    """ids of texts as flat arrays.  keeps_blanks: a piece after a blank keeps it (byte-level vocabularies), else blanks go."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; threads of its own would each keep memory
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.keeps_blanks = self._plain([" a"]) != self._plain(["a"])
        self.mark = "\n" if self.keeps_blanks else " ~ "  # stands between pieces and always is one id of its own
        ((self.mark_id,),) = self._plain([self.mark])
        self.ending_ids = np.array([i for (i,) in self._plain([*ENDINGS])], np.uint32)
        self.words = self._words(path) if self.keeps_blanks else self.tokenizer
        self.clear()

    @staticmethod
    def _words(path: str) -> Tokenizer:
        """The tokenizer without its splitting pattern, which leaves a blank and letters in one piece anyway."""
        out = Tokenizer.from_file(path)
        out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return out

    def _plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self):
        self.index = _Numbers()
        self.start = self.size = self.uses = np.zeros(0, np.int64)
        self.ids, self.long_chars = np.zeros(0, np.uint32), 0

    def _forget(self, least: int = 2) -> None:
        """Keeps the pieces that were met `least` times, halving their counts; most of a full memo are pieces met once."""
        while (keep := np.flatnonzero(self.uses >= least)).size > MEMO_PIECES // 2:
            least *= 2
        self.long_chars = 0
        names = list(self.index)
        self.index = _Numbers(zip(map(names.__getitem__, keep.tolist()), range(len(keep))))
        size = self.size[keep]
        self.ids = self.ids[np.repeat(self.start[keep], size) + ragged_arange(size)]
        self.start, self.size, self.uses = np.cumsum(size) - size, size, (self.uses[keep] + 1) // 2

    def _cased(self, text: str) -> str:
        if not self.keeps_blanks:
            try:  # this vocabulary has lower case only; doing it first makes more pieces equal
                text = text.encode("latin-1").decode("latin-1").lower()
            except UnicodeEncodeError:
                pass  # other letters are left to the tokenizer's own rules
        return text

    def _marked(self, text: str) -> str | None:
        """The pieces of a plain text, zero characters between them; none if it has more than single blanks and line feeds between words."""
        if text[0].isspace() or text[-1].isspace() or any(map(text.__contains__, ODD)):
            return None
        if self.keeps_blanks:
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        return text.replace("\n", "\0").replace(" ", "\0")

    def _pieces(self, text: str) -> list[str]:
        """The pieces of any text."""
        if not self.keeps_blanks:
            return [w for w in text.replace("\n", " ").split(" ") if w]
        out, at = [], 0
        for m in CUT.finditer(text):
            out.append(text[at : m.start()])
            at = m.start()
            if m.group(2):
                out.append("\n")
                at += 1
        return [*out, text[at:]] if text[at:] else out

    def _numbered(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(counts, at): how many pieces each text has, and their numbers in the index.  Equal pieces are looked up once."""
        texts = [self._cased(t) for t in texts]
        marked = [self._marked(t) if t else None for t in texts]
        plain = np.array([m is not None for m in marked], bool)
        rest = [self._pieces(t) if t else [] for t, m in zip(texts, marked, strict=True) if m is None]
        split = pc.split_pattern(pa.array(list(compress(marked, plain.tolist())), pa.large_string()), "\0")
        counts = np.zeros(len(texts), np.int64)
        counts[plain], counts[~plain] = np.diff(split.offsets.to_numpy()), [len(r) for r in rest]
        found = pa.chunked_array([split.flatten(), pa.array(chain.from_iterable(rest), pa.large_string())]).combine_chunks().dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist() makes a scalar of each
        at = np.fromiter(map(self.index.__getitem__, names), np.int64, len(names))[found.indices.to_numpy()]
        if rest:  # plain texts came first
            order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
            start = np.empty(len(texts), np.int64)
            start[order] = np.cumsum(counts[order]) - counts[order]
            at = at[np.repeat(start, counts) + ragged_arange(counts)]
        return counts, at

    def _learn(self, known: int) -> int:
        """Adds the ids of the pieces that the index has numbered from `known` on; returns the length of the longest.

        A word with a closing comma or full stop gets the ids of the word, which is learned once for all its endings, and
        the mark's: the tokenizers split there too.
        """
        fresh = list(islice(self.index, known, None))
        ended = [i for i, p in enumerate(fresh) if p[-1] in ENDINGS and p[-2:-1].isalpha()]
        bare = np.fromiter(map(self.index.__getitem__, [fresh[i][:-1] for i in ended]), np.int64, len(ended))
        whole = np.ones(len(self.index) - known, bool)
        whole[ended] = False
        every = fresh + list(islice(self.index, known + len(fresh), None))
        own_size, own_ids = self._encoded(list(compress(every, whole.tolist())))
        start, size = np.zeros(len(whole), np.int64), np.zeros(len(whole), np.int64)
        start[whole], size[whole] = len(self.ids) + np.cumsum(own_size) - own_size, own_size
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, own_ids])
        if ended:
            size = self.size[bare] + 1
            ids = np.empty(int(size.sum()), np.uint32)
            last = np.cumsum(size) - 1
            body = np.ones(len(ids), bool)
            body[last] = False
            ids[body] = self.ids[np.repeat(self.start[bare], size - 1) + ragged_arange(size - 1)]
            ids[last] = self.ending_ids[[ENDINGS.index(fresh[i][-1]) for i in ended]]
            at = known + np.array(ended)
            self.start[at], self.size[at] = len(self.ids) + last + 1 - size, size
            self.ids = np.concatenate([self.ids, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(whole), np.int64)])
        return max(map(len, fresh))

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(size, ids) of pieces.  Plain ones are encoded some together, a mark between them, and split at the mark's id; where
        a tokenizer keeps blanks, words of letters alone need no splitting by its pattern."""
        mark = self.mark.strip(" ")
        kind = np.zeros(len(pieces), np.int8)
        if self.keeps_blanks:
            kind[[i for i, p in enumerate(pieces) if (p[1:] if p[0] == " " else p).isalpha()]] = 1
        body = slice(1, None) if self.keeps_blanks else slice(None)
        others = np.flatnonzero(kind == 0).tolist()
        kind[[i for i in others if mark not in pieces[i] and pieces[i][-1:].strip() and pieces[i][body][:1].strip()]] = 2
        sizes, ids, order = [], [], []
        for k, tokenizer in ((1, self.words), (2, self.tokenizer)):
            own = np.flatnonzero(kind == k)
            some = list(compress(pieces, (kind == k).tolist()))
            groups = tokenizer.encode_batch_fast([self.mark.join([*some[i : i + TOGETHER], ""]) for i in range(0, len(some), TOGETHER)], add_special_tokens=False)
            joined = np.fromiter(chain.from_iterable(g.ids for g in groups), np.uint32)
            stops = np.flatnonzero(joined == self.mark_id)
            sizes.append(np.diff(stops, prepend=-1) - 1)
            ids.append(np.delete(joined, stops))
            order.append(own)
        own = np.flatnonzero(kind == 0)
        rest = self._plain([pieces[i] for i in own.tolist()])
        sizes.append(np.array([len(r) for r in rest], np.int64))
        ids.append(np.fromiter(chain.from_iterable(rest), np.uint32))
        order.append(own)
        back = np.argsort(np.concatenate(order))
        size, flat = np.concatenate(sizes), np.concatenate(ids)
        start = np.cumsum(size) - size
        return size[back], flat[np.repeat(start[back], size[back]) + ragged_arange(size[back])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        self.used = time.monotonic()
        if len(self.index) > MEMO_PIECES:
            self._forget()
        known = len(self.index)
        counts, at = self._numbered(texts)
        longest = self._learn(known) if len(self.index) > known else 0
        self.uses += np.bincount(at, minlength=len(self.uses))
        size = self.size[at]
        flat = self.ids[np.repeat(self.start[at], size) + ragged_arange(size)]
        sizes = np.concatenate([[0], np.cumsum(size)])
        offsets = sizes[np.concatenate([[0], np.cumsum(counts)])]
        if longest > MEMO_CHARS:  # long pieces hardly recur
            long = [(known + i, len(p)) for i, p in enumerate(islice(self.index, known, None)) if len(p) > MEMO_CHARS]
            self.uses[[i for i, _ in long]] = 0
            self.long_chars += sum(n for _, n in long)
            if self.long_chars > MEMO_LONG_CHARS:
                self._forget(1)
        return offsets, flat


def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker: its memo outlives a task, so later tasks of the worker start warm.

    Workers outlive a stage too; an encoder that is not used for IDLE_SECONDS is let go, so that other stages have its memory.
    """
    cache = sys.modules.setdefault("larder_worker_cache", types.ModuleType("larder_worker_cache")).__dict__.setdefault("encoders", {})
    held = cache.get(path)
    if held is None:
        held = cache[path] = PieceEncoder(path)
        _let_go_when_idle(cache, path)
    held.used = time.monotonic()
    return held


def _let_go_when_idle(cache: dict, path: str) -> None:
    def look():
        if time.monotonic() - cache[path].used < IDLE_SECONDS:
            wait()
            return
        del cache[path]
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    def wait():
        timer = threading.Timer(IDLE_SECONDS, look)
        timer.daemon = True
        timer.start()

    wait()


def with_end(offsets: np.ndarray, ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id `end` after each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    mask = np.ones(len(out), bool)
    mask[offsets[1:] + np.arange(n)] = False
    out[mask] = ids
    return offsets + np.arange(n + 1), out
