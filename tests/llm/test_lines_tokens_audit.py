"""Line dedup, token alignment and the filter audit against brute force, odd rows included."""

from __future__ import annotations

import hashlib
import random
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from larder.llm import alignment, audit, linededup, packing, queries, records

SPACES = " \t\n\v\f\r"
LONG = "one line of many words that repeats\n" * 20_000


def docs_of(spark, rows, extra: bool = True):
    """Rows (doc_id, text, lang) with columns whose names clash with those that the operators make."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    names = ("id", "key", "at", "n", "row", "part", "mask", "pairs", "first", "lines", "source")
    return df.withColumns({c: F.lit(1) for c in names}) if extra else df


def some_rows(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    lines = ["", " ", "short", "A shared line of text", "a SHARED line of text \t", "éÉ a line with letters", "ÉÉ a line with letters", "only # here", "x" * 10, " " * 12, "ends.\r"] + [f"own line number {i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8))), rng.choice(["en", "de", None])) for i in range(n)]
    rows += [(n, None, "en"), (n + 1, "", None), (None, "A shared line of text\nand more", "en"), (None, None, None), (n + 2, LONG, "de"), (n + 3, LONG + "tail of its own", "de"), rows[3], rows[3], (5, "another text of a repeated id\nA shared line of text", "fr")]
    return rows


# --- line dedup ---


def key_of(line: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute_lines(rows, least_docs=2, least_chars=10):
    held: dict[str, set] = {}
    for i, text, _ in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key_of(line)) >= least_chars:
                held.setdefault(key_of(line), set()).add(i)
    out = []
    for i, text, _ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if i is None or len(key_of(x)) < least_chars or len(held[key_of(x)]) < least_docs or min(held[key_of(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least_docs", [2, 4])
def test_lines_go_as_by_brute_force(spark, least_docs):
    rows = some_rows(least_docs)
    found = linededup.dedup_lines(docs_of(spark, rows), least_docs=least_docs).collect()
    assert sorted([tuple(r) for r in found], key=repr) == brute_lines(rows, least_docs)


def test_line_dedup_without_hot_hashes_and_of_an_empty_table(spark, monkeypatch):
    rows = some_rows(9)
    monkeypatch.setattr(linededup, "HOT_HASHES", 1)  # no hash is hot: all go by the shuffled join
    assert sorted([tuple(r) for r in linededup.dedup_lines(docs_of(spark, rows)).collect()], key=repr) == brute_lines(rows)
    assert linededup.dedup_lines(docs_of(spark, [])).count() == 0


def test_line_dedup_runs_without_python_workers(spark):
    plan = linededup.dedup_lines(docs_of(spark, some_rows(1)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_ascii_lower_touches_no_other_letter(spark):
    df = spark.createDataFrame([("ABC xyz",), ("ÀÉ AZ ß İ",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(linededup.ascii_lower(F.col("t"))).collect()] == ["abc xyz", "ÀÉ az ß İ", "", None]


# --- alignment ---


@pytest.fixture(scope="module")
def paths():
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_groups(aligner, text):
    """Counts, the groups' text and links of a whole text, all pairs of each group looked at."""
    none = (0, 0, 0, 0), "", {}
    if not text:
        return none
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    data = [aligner.bytes_a[i] for i in a], [aligner.bytes_b[i] for i in b]
    if any(b"".join(x) != (" " + text).encode() for x in data):
        return none
    ends = [np.cumsum([len(t) for t in x]).tolist() for x in data]
    starts = [[0, *e[:-1]] for e in ends]
    groups, links = [], {}
    at = [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        own = []
        for k in (0, 1):
            to = ends[k].index(cut) + 1
            own.append(range(at[k], to))
            at[k] = to
        groups.append("|".join(",".join(str(ids[i]) for i in r) for ids, r in zip((a, b), own, strict=True)))
        for i in own[0]:
            for j in own[1]:
                if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j]):
                    links[a[i], b[j]] = links.get((a[i], b[j]), 0) + 1
    return (len(a), len(b), len(groups), sum(links.values())), ";".join(groups), links


def odd_texts(seed, n):
    rng = random.Random(seed)
    parts = [*"ab ,.\n  é漢🜁▁\0\r\t\x1c ²'1s", "<0x0A>", "|endoftext|", "'s", "<|endoftext|>", "</s>", "<s>", "<unk>", "  ", " word", " word,", "\n\n", "é", "　"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)] + [" ", "\n", "\na", "a\n", "a,", "a.", "1, b", "x., y", "word\n.", ", ."]


def test_groups_and_links_are_those_of_the_whole_text(paths, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_PIECES", 500)  # pieces are forgotten on the way
    monkeypatch.setattr(alignment, "CHUNK_CHARS", 300)  # and long texts cut
    aligner = alignment.Aligner(*paths)
    assert aligner.cuts_blanks and aligner.cuts_ends
    rng = random.Random(4)
    words = ["the", "of", "and,", "über", "naïve.", "日本語", "x1", "can't", "Ünïcödé", "🜁", "...", "end."]
    prose = [" ".join(rng.choice(words) + rng.choice(["", "", "s", "ing"]) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts = odd_texts(3, 3000) + prose
    for text, (totals, digest, pairs, times) in zip(texts, aligner.align(texts), strict=True):
        counts, groups, links = brute_groups(aligner, text)
        assert tuple(totals.tolist()) == counts, text
        assert digest == (hashlib.sha256(groups.encode()).hexdigest() if counts[0] else "")
        assert {(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(pairs.tolist(), times.tolist(), strict=True)} == links


def test_byte_tables_give_texts_back(paths):
    aligner = alignment.Aligner(*paths)
    text = "".join(map(chr, [*range(1, 0x2FF), 0x4E00, 0x1F701])).replace("▁", "")
    assert b"".join(aligner.bytes_a[i] for i in aligner.a.encode(text, add_special_tokens=False).ids) == text.encode()
    assert b"".join(aligner.bytes_b[i] for i in aligner.b.encode(text)) == (" " + text).encode()


@pytest.mark.parametrize("hot", [1, 50, 10**9])
def test_alignment_counts_over_documents(spark, paths, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)  # none, some, all pairs are hot
    rows = [(i, t, "en") for i, t in enumerate(odd_texts(8, 60))] + [(None, "a word", "en"), (900, None, None), (901, "", None), (902, "same text here", "en"), (902, "same text here", "en"), (903, "bad ▁ mark", "en"), (904, "line of text. " * 2000, "de")]
    aligner = alignment.Aligner(*paths)
    whole = [(i, *brute_groups(aligner, t)) for i, t, _ in rows]
    docs: dict = {}
    for *_, links in whole:
        for pair in links:
            docs[pair] = docs.get(pair, 0) + 1
    most: dict = {}
    for (a, _), n in docs.items():
        most[a] = max(most.get(a, 0), n)
    expected = [(i, *counts, sum(n for p, n in links.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in links.items()), hashlib.sha256(g.encode()).hexdigest() if counts[0] else "") for i, counts, g, links in whole]
    found = alignment.alignment(docs_of(spark, rows), *paths).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert found[0].asDict().keys() == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}


def test_alignment_of_an_empty_table(spark, paths):
    assert alignment.alignment(docs_of(spark, []), *paths).count() == 0


# --- audit ---


def brute_audit(rows, good, toxic):
    firsts: dict = {}
    for i, text, _ in rows:
        if i is not None:
            firsts[text or ""] = min(firsts.get(text or "", i), i)
    docs = []
    for i, text, part in rows:
        t = text or ""
        words = [w.decode() for w in t.encode().split()]
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and firsts[t] < i,
        }
        docs.append((part or "", i, {f for f, x in failed.items() if x}))
    out, shares = {}, {}
    for order in permutations("ABCDE"):
        for part in {p for p, *_ in docs}:
            left = [d for d in docs if d[0] == part]
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[2]]
                every = [d for d in docs if d[0] == part and f in d[2]]
                left = [d for d in left if f not in d[2]]
                out[part, "".join(order), k + 1] = (len(left), len(gone), len(every) - len(gone), sum(d[2] == {f} for d in every), sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone))
                shares[part, f] = shares.get((part, f), 0) + len(gone)
    return {(p, o, k): (*v, shares[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_audit_is_that_of_all_orders_run_one_by_one(spark):
    rng = random.Random(2)
    rows = some_rows(7)
    rows += [(1000 + i, " ".join(rng.choice(["Word", "other", "more", f"w{j}"]) for j in range(rng.choice([50, 150]))) + rng.choice(["", " #", " CAPITALS" * 30]), rng.choice(["en", "de", None])) for i in range(80)]
    ids = [i for i, *_ in rows]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in ids[::2]] + [(ids[0], 1, 1), (None, 1, 1), (99999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("n", F.lit(7))
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit.audit(docs_of(spark, rows), table).collect()}
    assert found == brute_audit(rows, good, toxic)


def test_audit_without_documents_and_without_labels(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert audit.audit(docs_of(spark, []), none).count() == 0
    rows = audit.audit(docs_of(spark, [(1, None, None), (2, "", None)]), none).collect()
    assert len(rows) == 600 and {r["part"] for r in rows} == {""} and all(r["good_lost"] == r["toxic_lost"] == 0 for r in rows)
    assert {r["removed"] for r in rows if r["filter_order"] == "EABCD" and r["step"] == 1} == {1}


@pytest.mark.parametrize("n", [2, 3, 5])
def test_least_squares_give_the_mean_over_orders(n):
    rng = random.Random(n)
    value = [0, *[rng.randint(0, 99) for _ in range((1 << n) - 1)]]
    weights = audit.kernel_weights(n)
    orders = list(permutations(range(n)))
    for k in range(n):
        gains = [value[b | 1 << k] - value[b] for o in orders for b in [sum(1 << x for x in o[: o.index(k)])]]
        assert sum(w * v for w, v in zip(weights[k], value, strict=True)) * len(orders) == sum(gains)


def test_new_queries_are_registered():
    assert {"op11_line_dedup", "op12_token_alignment", "op13_filter_audit"} <= queries.QUERIES.keys()
    assert {"op11_line_dedup", "op13_filter_audit"} <= queries.ORACLE_SQL.keys()


# --- rules of earlier operators by brute force


@pytest.mark.parametrize("window", [2, 7, 32])
def test_sum_of_squares_places_as_by_trying_every_level(window):
    rng = random.Random(window)
    packer, levels = packing.SumOfSquares(window), [0] * (window + 1)
    for _ in range(800):
        length, tried = rng.randint(1, window - 1), []
        for level in range(window - length, -1, -1):  # the fullest first: it wins among equal ones
            if level and not levels[level]:
                continue
            after = list(levels)
            after[level] -= bool(level)
            after[level + length] += level + length < window
            tried.append((sum(n * n for n in after[1:window]), -level))
        level = -min(tried)[1]
        assert packer.place(length)[1] == level
        levels[level] -= bool(level)
        levels[level + length] += level + length < window
        levels[0] = levels[window] = 0


def test_folders_of_object_stores_and_unknown_ones(spark):
    with pytest.raises(Exception, match="nosuch"):
        records.write_records(docs_of(spark, [(1, "a", "en")]), "nosuch://place/records", public_tokenizers.path("word_bpe_49k.json"))
