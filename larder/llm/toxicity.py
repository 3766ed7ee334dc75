"""Toxicity scores: a lexicon trie intersected with Levenshtein automata, and a model of hits in their context.

Terms are whole words, or stems that longer words begin with.  A word is run through the product of the trie and an
edit-distance automaton (insert, delete, substitute, swap neighbours), built lazily as a deterministic automaton, so
misspelled terms are caught at the price of a table look-up per character.  The words around each hit tell a quotation
or report from direct abuse; hits of both kinds are separate features of a logistic model.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, written

WORD = re.compile(r"[^\W_]+(?:[@$!*][^\W_]+)*")
WORD_JVM = "[\\p{L}\\p{M}\\p{N}]+"
# Characters written for letters.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
# Words that report speech, and marks that open a quotation with those that close it.
REPORTING = frozenset("said says wrote writes quoted quote called calls zitat sagte schrieb dit écrit citation dijo escribió cita".split())
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’", "`": "`´"}
MARK = re.compile("[\"“”„«»‘’`´]|\n\\s*\n")
#: Characters before a hit in which reporting words are looked for.
CONTEXT_CHARS = 48
FEATURES = 5
#: Weights that features keep which the labelled rows never show; the last is the bias.
PRIOR = (0.8, 0.3, 3.0, 3.0, 1.0, -2.5)
STEM_CHARS = (4, 5, 6, 7, 8)
#: What a worker may hold: words and their edits, and (node, edits, awaited) triples of the automaton's states (some 100 bytes each).
MEMO_WORDS = 100_000
MEMO_ITEMS = 300_000


def allowed_edits(length: int) -> int:
    """Edits that a term of this length forgives; in a stem they lie before its last character."""
    return 0 if length < 5 else 1 if length < 10 else 2


@dataclass
class LexiconAutomaton:
    """Lazy deterministic product of the lexicon's trie and the edit automata.

    A state is a set of (node, edits, awaited) triples; `awaited` is the second character of a swapped pair.
    Matching returns the least number of edits of a term that fits the whole word or of a stem that it goes on from, else
    None.  A stem's last character must stand in the word, and another one after it: otherwise the word has a shorter stem,
    or is the stem alone, which were not learned.
    """

    words: list[str]
    stems: list[str]
    exceptions: frozenset = frozenset()  # words near a term that clean documents use
    children: list[dict] = field(default_factory=list)
    ends: list[tuple] = field(default_factory=list)

    def __post_init__(self):
        self.children, limit, whole, stem = [{}], [0], [False], [False]
        for terms, marks in ((self.words, whole), (self.stems, stem)):
            for term in terms:
                at = 0
                for c in term:
                    if c not in self.children[at]:
                        self.children[at][c] = len(self.children)
                        self.children.append({})
                        for x, v in ((limit, 0), (whole, False), (stem, False)):
                            x.append(v)
                    at = self.children[at][c]
                marks[at] = True
        best = [-1] * len(self.children)  # the most edits that a term below a node forgives
        depth = {0: 0}
        order = [0]
        for at in order:
            for child in self.children[at].values():
                depth[child] = depth[at] + 1
                order.append(child)
        for at in reversed(order):
            own = allowed_edits(depth[at]) if whole[at] or stem[at] else -1
            best[at] = max([own, *(best[c] for c in self.children[at].values())])
        self.ends = [(best[n], allowed_edits(depth[n]) if whole[n] else -1, allowed_edits(depth[n]) if stem[n] else -1) for n in range(len(self.children))]
        self.reset()

    def reset(self):
        self.table: dict = {}
        self.states: list[frozenset] = []
        self.index: dict[frozenset, int] = {}
        self.held = 0
        self.accepts: list[int] = []
        self.start = self._number(self._closed({(0, 0, "")}))

    def without_exceptions(self) -> LexiconAutomaton:
        return LexiconAutomaton(self.words, self.stems)

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "exceptions": self.exceptions}

    def __setstate__(self, state):
        self.words, self.stems, self.exceptions = state["words"], state["stems"], state["exceptions"]
        self.__post_init__()

    def _closed(self, items: set) -> frozenset:
        """Adds what skipping characters of a term reaches; drops what no term below allows."""
        todo, out = list(items), set()
        while todo:
            node, edits, awaited = item = todo.pop()
            if item in out or edits > self.ends[node][0]:
                continue
            out.add(item)
            if not awaited:
                todo.extend((child, edits + 1, "") for child in self.children[node].values())
        return frozenset(out)

    def _number(self, items: frozenset) -> int:
        if not items:
            return -1
        if items not in self.index:
            self.index[items] = len(self.states)
            self.states.append(items)
            self.held += len(items)
            whole = [e for n, e, a in items if not a and e <= self.ends[n][1]]
            self.accepts.append(min(whole, default=-1))
        return self.index[items]

    def _next(self, state: int, c: str) -> tuple[int, int]:
        """The state after c, and the least edits of a stem that ends with c, or -1."""
        moved, stems = set(), []
        for node, edits, awaited in self.states[state]:
            if awaited:
                if c == awaited:
                    moved.add((node, edits, ""))
                    if edits <= self.ends[node][2]:
                        stems.append(edits)
                continue
            kids = self.children[node]
            if c in kids:
                moved.add((kids[c], edits, ""))
                if edits <= self.ends[kids[c]][2]:
                    stems.append(edits)
            moved.add((node, edits + 1, ""))
            for d, child in kids.items():
                if d != c:
                    moved.add((child, edits + 1, ""))
                    if c in self.children[child]:
                        moved.add((self.children[child][c], edits + 1, d))
        return self._number(self._closed(moved)), min(stems, default=-1)

    def match(self, word: str) -> int | None:
        if self.held + len(self.table) > MEMO_ITEMS:
            self.reset()
        state, table = self.start, self.table
        if state < 0:  # an empty lexicon
            return None
        best = None
        last = len(word) - 1
        for i, c in enumerate(word):
            after = table.get((state, c))
            if after is None:
                after = table[(state, c)] = self._next(state, c)
            state, edits = after
            if i < last:
                if edits == 0:
                    return 0
                if edits > 0 and (best is None or edits < best):
                    best = edits
            if state < 0:
                return best
        edits = self.accepts[state]
        return best if edits < 0 or (best is not None and best < edits) else edits


def quotations(text: str) -> list[tuple[int, int]]:
    """(start, end) of each quotation, marks included, within a paragraph.

    A mark opens one if no letter stands before it and no space after it, and only the marks that belong to it close it, if
    no space stands before them and no letter after.  So apostrophes within words are none, nor is what stands between two
    quotations, and a mark that is never closed quotes nothing.
    """
    out, start, closing = [], -1, ""
    for m in MARK.finditer(text):
        c, at = m.group(), m.start()
        before, after = text[at - 1 : at] if at else "", text[at + 1 : at + 2]
        if c[0] == "\n":
            start = -1
        elif start >= 0 and c in closing and not before.isspace() and not after.isalnum():
            out.append((start, at + 1))
            start = -1
        elif start < 0 and c in QUOTES and not before.isalnum() and after and not after.isspace():
            start, closing = at, QUOTES[c]
    return out


def without_quotations(text: str) -> str:
    for a, b in reversed(quotations(text)):
        text = f"{text[:a]} {text[b:]}"
    return text


def unquoted(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([without_quotations(t) if t else t for t in batch.to_pylist()], pa.string())

    return run(text)


def hits(text: str, automaton: LexiconAutomaton, memo: dict) -> list[tuple[int, int, int, bool]]:
    """(start, end, edits, quoted) of each word of the text that fits a term."""
    out, spans = [], None
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer: positions stay those of the lowered text
        text = lowered
    for m in WORD.finditer(lowered):
        word = m.group()
        edits = memo.get(word, -2)
        if edits == -2:
            edits = automaton.match(word)
            if edits is None and not word.isalpha():
                folded = word.translate(LEET)
                edits = automaton.match(folded) if folded.isalpha() else None
                edits = edits if edits is None else max(1, edits)
            if edits and word in automaton.exceptions:
                edits = None
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            if len(word) <= 40:
                memo[word] = edits
        if edits is not None:
            spans = quotations(text) if spans is None else spans
            at = bisect.bisect_right(spans, (m.start(), len(text))) - 1
            marks = at >= 0 and m.end() <= spans[at][1]
            told = not REPORTING.isdisjoint(WORD.findall(text[max(0, m.start() - CONTEXT_CHARS) : m.start()].lower())[-2:])
            out.append((m.start(), m.end(), edits, marks or told))
    return out


def features(found: list[tuple[int, int, int, bool]]) -> list[float]:
    """Direct hits (an edit weighs 0.8), quoted hits, whether there is a direct one as written, a misspelled one, a quoted one."""
    direct = sum(0.8**edits for _, _, edits, told in found if not told)
    quoted = sum(0.8**edits for _, _, edits, told in found if told)
    plain = any(not edits for _, _, edits, told in found if not told)
    return [math.log1p(direct), math.log1p(quoted), float(plain), min(1.0, direct) * (not plain), min(1.0, quoted)]


@dataclass
class ToxicityModel:
    automaton: LexiconAutomaton
    weights: np.ndarray  # FEATURES, then the bias


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, order: Column, max_rows: int) -> DataFrame:
    """(text, label) of at most max_rows labelled documents, chosen by `order` over the labels; those ids are few enough to broadcast.

    Written, so that the documents are read once for all that is learned.
    """
    chosen = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label"), order.alias("__rank"))
    chosen = chosen.orderBy("__rank", "__id").limit(max_rows).drop("__rank")
    rows = docs.select(F.col(id_col).alias("__id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    return written(rows.join(F.broadcast(chosen), "__id").select("text", "label"), "labelled")


def unlike_rows(sample: DataFrame, *, bands: int = 6, size: int = 3) -> DataFrame:
    """The distinct (text, label) of a sample, toxic near copies once.

    Toxic rows that share `size` least hashes of their word triples are one, band after band, so a hot group of copies or
    near copies counts as about one document.  Only hashes are grouped; clean rows are taken out as exact copies only.
    """
    rows = sample.select("text", "label").distinct().withColumn("__key", F.xxhash64("text", "label"))
    rows = written(rows, "distinct-labelled")
    w = F.regexp_extract_all("text", F.lit(WORD_JVM), F.lit(0))
    triples = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.slice("w", i + 1, 3)))
    names = [f"b{k}" for k in range(bands)]
    least = [[F.array_min(F.transform("t", lambda x, seed=k * size + j: F.xxhash64(x, F.lit(seed)))) for j in range(size)] for k in range(bands)]
    keys = rows.where("label = 1").select("__key", w.alias("w")).select("__key", triples.alias("t")).select("__key", *[F.xxhash64(*m).alias(n) for n, m in zip(names, least, strict=True)])
    for n in names:
        keys = keys.groupBy(n).agg(F.min(F.struct("__key", *names)).alias("s")).select("s.*")
    return rows.join(F.broadcast(keys.select("__key", F.lit(True).alias("__kept"))), "__key", "left").where("label = 0 OR __kept").select("text", "label")


def learn_lexicon(sample: DataFrame, *, least_gain: float = 20.0, least_contexts: int = 5, least_share: float = 0.9, least_chars: int = 3, seeds: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """Words of least_chars or more characters, and stems of 4 to 8 that longer words go on from, that toxic documents hold far more often than others do.

    Documents per term and label are counted in Spark, copies once and quotations left out (what clean documents quote is no
    clean use).  A term needs a toxic share of least_share, least_gain of log likelihood ratio and least_contexts pairs of
    neighbours; all such terms of the bounded sample reach the driver, which keeps the shortest stem that says as much as what
    it begins.
    """
    sample = written(unlike_rows(sample).select(unquoted(F.col("text")).alias("text"), "label"), "unlike")
    base = sample.groupBy("label").count().collect()
    total = {r["label"]: r["count"] for r in base}
    npos, nneg = total.get(1, 0), total.get(0, 0)
    if not npos:
        return sorted(seeds), []
    every = F.regexp_extract_all("text", F.lit(WORD_JVM), F.lit(0))

    def stems_of(n: int) -> Column:
        return F.transform(F.filter(F.col("w"), lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))

    stems = [stems_of(n) for n in STEM_CHARS]
    terms = sample.select("label", F.array_distinct(every).alias("w")).select("label", F.explode(F.array_distinct(F.concat(F.filter("w", lambda w: F.length(w) >= least_chars), *stems))).alias("term"))
    counted = terms.groupBy("term").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    p, q = F.col("pos") / F.col("n"), F.lit(npos / (npos + nneg) if nneg else 0.5)
    gain = F.col("n") * (p * F.log(p / q) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - q))).otherwise(0.0)) * 2
    found = counted.where((F.col("pos") >= 3) & (p >= least_share)).select("term", "pos", "n", gain.alias("gain")).where(F.col("gain") >= least_gain)
    found = written(found, "terms")
    # What several toxic documents quote makes every word of it look toxic.  Such a word has the same neighbours each time;
    # a term of abuse has others.  The number of contexts counts, not their share, which grows smaller with each repetition.
    placed = sample.where("label = 1").select(F.concat(F.array(F.lit("")), every, F.array(F.lit(""))).alias("w")).select(F.posexplode("w").alias("i", "x"), "w").where(F.length("x") >= least_chars)
    placed = placed.select("x", F.xxhash64(F.get("w", F.col("i") - 1)).alias("before"), F.xxhash64(F.get("w", F.col("i") + 1)).alias("after"))
    forms = F.array_compact(F.array(F.col("x"), *[F.when(F.length("x") > n, F.concat(F.substring("x", 1, n), F.lit("*"))) for n in STEM_CHARS]))
    held = placed.select("before", "after", F.explode(forms).alias("term")).join(F.broadcast(found), "term")
    contexts = held.groupBy("term").agg(F.countDistinct("before", "after").alias("contexts"))
    rows = found.join(contexts, "term").where((F.col("contexts") >= least_contexts) & (F.col("contexts") * 2 * F.log(F.lit(1.0) / q) >= least_gain)).collect()
    return _shortest({r["term"]: r["pos"] for r in rows}, seeds)


def _shortest(found: dict[str, int], seeds: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """(words, stems) of the terms and their counts; a stem goes if one word or a longer stem says as much, or a shorter one is kept.  Whole words stay beside a stem: they forgive edits at any character."""
    stems = {t[:-1]: n for t, n in found.items() if t.endswith("*")}
    plain = {t: n for t, n in found.items() if not t.endswith("*")}
    in_word: dict[str, int] = {}  # the most that one word says of each beginning
    in_stem: dict[str, int] = {}
    for w, n in plain.items():
        for i in STEM_CHARS:
            in_word[w[:i]] = max(in_word.get(w[:i], 0), n)
    for s, n in stems.items():
        in_stem[s[:-1]] = max(in_stem.get(s[:-1], 0), n)
    kept: set[str] = set()
    for s in sorted(stems, key=lambda s: (len(s), s)):
        if in_word.get(s, 0) < 0.9 * stems[s] and in_stem.get(s, 0) < 0.98 * stems[s] and not any(s[:i] in kept for i in range(1, len(s))):
            kept.add(s)
    return sorted({*plain, *seeds}), sorted(kept)


def learn_exceptions(sample: DataFrame, automaton: LexiconAutomaton) -> frozenset:
    """Words an edit or two from a term that are words of their own, not misspellings: clean documents of the bounded sample hold
    them outside quotations more than half as often as toxic ones do."""

    def near(batches):
        memo: dict = {}
        for part in slices(batches, "text"):
            words, marks = [], []
            for t, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = {t[a:b] for a, b, edits, told in hits(t, automaton, memo) if edits and not told}
                words += own
                marks += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(marks, pa.int32())], names=["word", "label"])

    rows = sample.select("text", "label").mapInArrow(near, "word string, label int").groupBy("word").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    return frozenset(r["word"].lower() for r in rows.where("pos < 2 * (n - pos)").select("word").collect())


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, *, ridge: float = 2.0, steps: int = 30) -> np.ndarray:
    """Newton steps towards the ridge-penalised optimum around `prior`, so that features the sample never shows keep their prior weight."""
    x = np.column_stack([x, np.ones(len(x))])
    w, pull = prior.astype(float).copy(), np.full(x.shape[1], ridge)
    pull[-1] = 0.01
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (y - p) - pull * (w - prior))
        w += np.clip(step, -3, 3)
    return w


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", order: Column, max_rows: int = 20_000, seeds: tuple[str, ...] = ()) -> ToxicityModel:
    """Learns the lexicon and the logistic model on at most max_rows labelled documents; the driver sees terms and feature rows, no texts.

    The weights are fitted on one half of the rows with the exceptions of the other half, so that misspellings are weighed as
    they do on texts not seen before; then exceptions are learned on all rows.
    """
    sample = labelled_sample(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, order=order, max_rows=max_rows)
    automaton = LexiconAutomaton(*learn_lexicon(sample, seeds=seeds))
    half = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2))
    unlike = written(unlike_rows(sample).withColumn("half", half), "unlike-labelled")
    automaton.exceptions = learn_exceptions(unlike.where("half = 0"), automaton)

    def measure(batches):
        memo: dict = {}
        for part in slices(batches, "text"):
            rows = [features(hits(t, automaton, memo)) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), part.column(1)], names=["x", "label"])

    rows = sample.where(half == 1).select("text", "label").mapInArrow(measure, "x array<double>, label int").groupBy("x", "label").count().collect()
    automaton.exceptions = learn_exceptions(unlike, automaton.without_exceptions())
    prior = np.array(PRIOR)
    if not rows:
        return ToxicityModel(automaton, prior)
    rows.sort(key=lambda r: (r["label"], r["x"]))
    x, y, n = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float), np.array([r["count"] for r in rows])
    return ToxicityModel(automaton, fit_logistic(np.repeat(x, n, axis=0), np.repeat(y, n), prior))


def scored(text: Column, model: ToxicityModel) -> Column:
    """A struct (score, n_hits, n_quoted) of a text column; null counts as empty.  Only the texts go to the Python workers."""

    @F.arrow_udf("score double, n_hits int, n_quoted int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo: dict = {}
        for batch in batches:
            x, n, q = np.zeros((len(batch), FEATURES)), np.zeros(len(batch), np.int32), np.zeros(len(batch), np.int32)
            for i, t in enumerate(batch):
                found = hits(t.as_py() or "", model.automaton, memo)
                x[i] = features(found)
                n[i], q[i] = len(found), sum(told for *_, told in found)
            z = np.clip(x @ model.weights[:-1] + model.weights[-1], -40, 40)
            yield pa.StructArray.from_arrays([pa.array(1 / (1 + np.exp(-z))), pa.array(n), pa.array(q)], names=["score", "n_hits", "n_quoted"])

    return run(text)


def score(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_hits, n_quoted) of every row's whole text.

    Null and empty texts have no hit and get the score of a text without hits.  Repeated rows get equal results; an empty
    table gives no row; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col), scored(F.col(text_col), model).alias("__found"))
    return rows.select(id_col, "__found.score", "__found.n_hits", "__found.n_quoted")


def keep_below(docs: DataFrame, model: ToxicityModel, limit: float, *, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below the limit, columns unchanged.

    Null and empty texts stay, and null ids; repeated rows are kept or dropped alike; an empty table stays empty.  Other
    columns are not read.
    """
    return docs.where(scored(F.col(text_col), model)["score"] < limit)
