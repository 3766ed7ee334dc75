"""Language identification with a byte convolutional network, trained in numpy.

The network embeds each byte, applies filters of several widths, takes the maximum of every filter over a
fixed-length window and ends in a softmax.  A text is cut into such windows; the softmax outputs of its windows,
weighted by their bytes, give the text's language and score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices, written

WINDOW = 256
UNDETERMINED = "und"


@dataclass
class ByteConvNet:
    """Weights; kernel holds all filters, the narrower ones padded with zero taps to the greatest width."""

    languages: list[str]
    embed: np.ndarray  # (256, d); byte 0 is padding
    kernel: np.ndarray  # (width * d, filters)
    kernel_bias: np.ndarray
    dense: np.ndarray  # (filters, languages)
    dense_bias: np.ndarray
    width: int

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Every position's next `width` embedded bytes: (n, positions, width * d)."""
        x = self.embed[windows]
        n, length, d = x.shape
        a, b, c = x.strides
        return np.lib.stride_tricks.as_strided(x, (n, length - self.width + 1, self.width * d), (a, b, c)).copy()

    def pooled(self, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, positions, k = cols.shape
        out = (cols.reshape(-1, k) @ self.kernel).reshape(n, positions, -1)
        return out.max(axis=1) + self.kernel_bias, out

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax outputs (n, languages) of byte windows (n, WINDOW), in small blocks to stay in the CPU's cache."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), 32):
            hidden, _ = self.pooled(self.columns(windows[i : i + 32]))
            out[i : i + 32] = _softmax(np.maximum(hidden, 0) @ self.dense + self.dense_bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_network(texts: list[bytes], langs: list[str], *, dim: int = 8, filters: dict[int, int] | None = None, epochs: int = 6, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> ByteConvNet:
    """Trains on byte strings (cut to WINDOW) with Adam; half of them are shortened at random in each epoch, so that short texts are learned too."""
    filters = filters or {2: 8, 3: 16, 4: 16}
    rng, width = np.random.default_rng(seed), max(filters)
    names = sorted(set(langs)) or [UNDETERMINED]
    y = np.searchsorted(names, langs) if langs else np.zeros(0, int)
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        x[i, : min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    lengths = np.array([min(len(t), WINDOW) for t in texts], int)
    mask = np.concatenate([np.repeat(np.arange(width)[:, None] < w, n, 1) for w, n in filters.items()], axis=1).repeat(dim, axis=0).astype(np.float32)
    k, f = mask.shape
    net = ByteConvNet(names, rng.normal(0, 0.5, (256, dim)).astype(np.float32), rng.normal(0, 0.3, (k, f)).astype(np.float32) * mask, np.zeros(f, np.float32), rng.normal(0, 0.3, (f, len(names))).astype(np.float32), np.zeros(len(names), np.float32), width)
    net.embed[0] = 0
    params = [net.embed, net.kernel, net.kernel_bias, net.dense, net.dense_bias]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            windows = x[rows].copy()
            keep = np.where(rng.random(len(rows)) < 0.5, lengths[rows], rng.integers(6, WINDOW + 1, len(rows)))
            windows[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
            cols = net.columns(windows)
            hidden, conv = net.pooled(cols)
            act = np.maximum(hidden, 0)
            dz = _softmax(act @ net.dense + net.dense_bias)
            dz[np.arange(len(rows)), y[rows]] -= 1
            dz /= len(rows)
            dh = (dz @ net.dense.T) * (hidden > 0)
            best = conv.argmax(axis=1)  # (n, filters): the position each maximum came from
            picked = np.take_along_axis(cols, best[:, :, None], axis=1)  # (n, filters, k)
            dkernel = np.einsum("nf,nfk->kf", dh, picked) * mask
            dcols = (dh[:, :, None] * net.kernel.T[None]).reshape(len(rows), f, width, dim)
            taps = windows[np.arange(len(rows))[:, None, None], best[:, :, None] + np.arange(width)[None, None]]
            dembed = np.zeros_like(net.embed)
            np.add.at(dembed, taps.ravel(), dcols.reshape(-1, dim))
            dembed[0] = 0
            step += 1
            for p, g, a, b in zip(params, [dembed, dkernel, dh.sum(0), act.T @ dz, dz.sum(0)], first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def shares(counts: DataFrame, rows: int) -> DataFrame:
    """(lang, share, below) of (lang, n): the share that lets all languages have about `rows` rows together, and the draw (of 2^30) below which a third more than it lie.

    Small languages are served first: each step's share is what is left, divided by the languages left; the greatest of
    these is the one that all larger languages can have.
    """
    order = Window.orderBy("n", "lang")  # a row a language
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.count("*").over(Window.partitionBy(F.lit(1))) - F.row_number().over(order) + 1
    stepped = counts.withColumn("each", F.floor((F.lit(rows) - before) / after))
    share = F.greatest(F.lit(1), F.max("each").over(Window.partitionBy(F.lit(1))))
    rows_share = stepped.withColumn("share", share.cast("bigint"))
    return rows_share.select("lang", "share", (F.least(F.lit(1.0), (1.3 * F.col("share") + 50) / F.col("n")) * (1 << 30)).alias("below"))


def training_windows(docs: DataFrame, text_col: str, lang_col: str, order: Column, max_docs: int) -> DataFrame:
    """At most max_docs rows, chosen within each language by `order` (a hash): text windows from the start, the middle and the end, and lang.

    Every language gets the same number of rows, or all that it has, and leaves the rest to the others.  Only if there are
    more than max_docs languages, some have none.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike("\\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), order.alias("rank"))
    rows = rows.withColumn("draw", F.pmod("rank", F.lit(1 << 30)))
    limits = written(shares(rows.groupBy("lang").agg(F.count("*").alias("n")), max_docs), "languages")
    # The threshold lets through about a third more than a language's share, however many rows it has; its first ones are taken of them.
    rows = rows.join(F.broadcast(limits), "lang").where("draw < below")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "rank", "text"))).where("place <= share")
    rows = rows.orderBy("place", "draw", "lang").limit(max_docs)
    last = F.greatest(F.lit(1), F.length("text") - WINDOW + 1)
    starts = F.array_distinct(F.array(F.lit(1), F.expr("int((greatest(1, length(text) - 256 + 1) + 1) / 2)"), last.cast("int")))
    return rows.select("lang", F.explode(F.transform(starts, lambda s: F.col("text").substr(s, F.lit(WINDOW)))).alias("window"))


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order: Column, max_docs: int = 3000) -> ByteConvNet:
    """Fits the network on at most max_docs labelled documents (three windows of each); that bound is what reaches the driver."""
    rows = training_windows(docs, text_col, lang_col, order, max_docs).collect()
    rows = sorted(rows)
    return fit_network([r["window"].encode() for r in rows], [r["lang"] for r in rows])


def identified(text: Column, net: ByteConvNet) -> Column:
    """A struct (lang_pred, score) of a text column.  Only the texts go to the Python workers."""

    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, scores = [], []
            for part in text_slices(batch):
                found = classify(net, part.to_pylist())
                langs += found[0]
                scores.append(found[1])
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], names=["lang_pred", "score"])

    return run(F.when(text.rlike("\\p{L}"), text))


def identify(docs: DataFrame, net: ByteConvNet, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text.

    A null text, or one without a letter, gives ('und', 0.0); equal texts get equal results; of equally likely languages the
    first by name is given; an empty table gives no row; other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col), identified(F.col(text_col), net).alias("__found"))
    return rows.select(id_col, "__found.lang_pred", "__found.score")


def classify(net: ByteConvNet, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; windows of all texts go through the network together."""
    full = [(i, t.encode()) for i, t in enumerate(texts) if t]
    langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if full:
        sizes = np.array([len(t) for _, t in full])
        n = -(-sizes // WINDOW)
        starts = np.cumsum(n) - n
        flat = np.zeros(int(n.sum()) * WINDOW, np.uint8)
        for (_, t), s in zip(full, starts, strict=True):
            flat[s * WINDOW : s * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
        windows = flat.reshape(-1, WINDOW)
        weight = np.full(len(windows), WINDOW, np.float32)
        weight[starts + n - 1] = sizes - (n - 1) * WINDOW
        votes = np.add.reduceat(net.probabilities(windows) * weight[:, None], starts, axis=0) / sizes[:, None]
        for (i, _), best, score in zip(full, votes.argmax(1), votes.max(1), strict=True):
            langs[i], scores[i] = net.languages[best], min(1.0, float(score))
    return langs, scores


def keep_identified(docs: DataFrame, net: ByteConvNet, least: float, *, text_col: str = "text") -> DataFrame:
    """The rows of docs with a letter in their text and a language of at least this score, columns unchanged.

    Null, empty and letterless texts go; repeated rows are kept or dropped alike; a null id does not matter; an empty table
    stays empty.  Other columns are not read.
    """
    return docs.where(F.col(text_col).rlike("\\p{L}")).where(identified(F.col(text_col), net)["score"] >= least)
