"""The corpus operators against brute-force versions, exact round trips and held-out accuracy."""

import collections
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import bagminhash, langid, lines, mixing, packing, queries, records, ring, topk, toxicity, urlgraph
from larder.llm.tokens import PieceEncoder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- 1 language identification


def test_language_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in queries.op1_language_id(spark, sf).collect() if r["held_out"]]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_every_language_gets_its_share_of_the_sample(spark):
    """Nine large languages and small ones: 300 rows would be each one's share, whatever the large ones' size."""
    sizes = {f"l{i}": n for i, n in enumerate([20_000] * 9)} | {"small": 300, "tiny": 40}
    rows = spark.createDataFrame(list(sizes.items()), "lang string, n int").selectExpr("lang", "explode(sequence(1, n)) AS i").withColumn("text", F.concat("lang", F.lit(" text "), "i"))
    for scale in (1, 5):
        many = rows.unionByName(rows.where("lang LIKE 'l_'").crossJoin(spark.range(scale - 1)).select("lang", "i", F.concat("text", F.lit("-"), "id").alias("text")))
        found = langid.training_windows(many, "text", "lang", F.xxhash64("text"), 3000).groupBy("lang").count().collect()
        got = {r["lang"]: r["count"] for r in found}
        assert got["tiny"] == 40 and got["small"] >= 290 and all(280 <= n <= 300 for k, n in got.items() if k[1:].isdigit()) and 2990 <= sum(got.values()) <= 3000
    given = spark.createDataFrame([("a", 5), ("b", 100), ("c", 10**9)], "lang string, n bigint")
    assert {r["lang"]: r["share"] for r in langid.shares(given, 3000).collect()} == dict.fromkeys("abc", 2895)
    few = langid.training_windows(rows.where("i <= 3"), "text", "lang", F.xxhash64("text"), 4)
    assert few.count() == 4 and few.select("lang").distinct().count() == 4


def test_a_small_language_is_told_apart(spark):
    rng = np.random.default_rng(3)
    alphabets = {f"l{i}": list("abcdefghijklmnopqrstuvwxyz"[2 * i : 2 * i + 6]) for i in range(9)} | {"small": list("éàçôù")}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k], 5)) for _ in range(30)), k) for k in alphabets for i in range(400 if k == "small" else 1500)]
    docs = spark.createDataFrame(rows, "i int, text string, lang string")
    net = langid.train(docs.where("i % 4 > 0"), order=F.xxhash64("text"), max_docs=600)
    assert "small" in net.languages
    got = docs.where("i % 4 = 0 AND lang = 'small'").select(langid.identified(F.col("text"), net)["lang_pred"].alias("p")).collect()
    assert np.mean([r["p"] == "small" for r in got]) > 0.9


def test_language_odd_rows(spark, odd_documents):
    net = langid.fit_network([b"the cat sat on the mat", b"le chat sur la table"] * 8, ["en", "fr"] * 8, epochs=2)
    rows = langid.identify(odd_documents, net).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    for r in rows:  # the network once more, a window at a time
        if r["lang_pred"] != "und":
            t = next(x["text"] for x in odd_documents.collect() if x["doc_id"] == r["doc_id"]).encode()
            total = np.zeros(2)
            for k in range(0, len(t), langid.WINDOW):
                piece = t[k : k + langid.WINDOW]
                x = net.embed[np.frombuffer(piece.ljust(langid.WINDOW, b"\0"), np.uint8)].astype(float)
                flat = np.array([x[i : i + net.width].ravel() for i in range(langid.WINDOW - net.width + 1)])
                z = np.maximum((flat @ net.kernel).max(0) + net.kernel_bias, 0) @ net.dense + net.dense_bias
                total += len(piece) * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            assert r["lang_pred"] == net.languages[int(total.argmax())] and abs(r["score"] - total.max() / len(t)) < 1e-4
    assert len(rows) == 8 and got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("en", "fr")
    assert langid.identify(odd_documents.limit(0), net).count() == 0
    assert langid.keep_identified(odd_documents.limit(0), net, 0.0).count() == 0
    assert {r["doc_id"] for r in langid.keep_identified(odd_documents, net, 0.0).collect()} == {None, 4, 5, 6}


# --- 2 url graph


def test_hosts_paths_and_longest_rule(spark):
    urls = [("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://x.org", "x.org", "", None, None), ("ftp://b.com/fr/2#t", "b.com", "/fr/2", "com/fr/", "allow"), ("b.com/fr/", "", "", None, None), (None, "", "", None, None), ("x://com?/de/", "com", "", None, None), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("http://h#a://b/c", "h", "", None, None)]
    df = spark.createDataFrame([(u,) for u, *_ in urls], "url string").select(urlgraph.host_of(F.col("url")).alias("host"), urlgraph.path_of(F.col("url")).alias("path"))
    rule, verdict = urlgraph.rule_of(F.col("host"), F.col("path"), queries.URL_RULES)
    assert [tuple(r) for r in df.select("host", "path", rule, verdict).collect()] == [tuple(u[1:]) for u in urls]


def brute_flows(links, seeds, names):
    """Personalised PageRank of both flows by a dense linear solve; mass of hosts without out-edges goes back to the seeds."""
    out = []
    for k, flip in ((1, False), (2, True)):
        start = np.array([float(sum(x[k] for x in seeds if x[0] == n)) for n in names])
        if not start.sum():
            out.append(np.zeros(len(names)))
            continue
        start /= start.sum()
        m = np.zeros((len(names), len(names)))
        for s, d, w in links:
            s, d = (d, s) if flip else (s, d)
            m[names.index(d), names.index(s)] += w
        total = m.sum(0)
        m = np.where(total > 0, m / np.where(total > 0, total, 1), start[:, None])
        out.append(0.15 * np.linalg.solve(np.eye(len(names)) - 0.85 * m, start))
    return dict(zip(names, zip(*out, strict=True), strict=True))


def test_propagation_solves_the_personalised_pagerank(spark):
    links = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 1.0), ("c", "a", 1.0), ("d", "c", 1.0), ("c", "e", 0.5)]  # e has no out-edge
    seeds = [("a", 3, 0), ("c", 1, 1), ("e", 0, 2)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in urlgraph.propagate(spark.createDataFrame(links, "src string, dst string, weight double"), spark.createDataFrame(seeds, "host string, trusted long, distrusted long")).collect()}
    want = brute_flows(links, seeds, list("abcde"))
    assert all(np.allclose(got.get(n, (0.0, 0.0)), want[n], atol=2e-3) for n in "abcde")


def test_verdicts_equal_brute_force(spark):
    """Generated pages with real links: absolute, protocol-relative, relative, quoted or not; repeated pages, nulls and clashing columns."""
    rng = np.random.default_rng(3)
    hosts = [f"{a}.{b}.{c}" for a in ("www", "m", "x.y") for b in ("one", "two", "three") for c in ("net", "org", "com")] + ["lone.edu", "10.0.0.1"]
    pages = []
    for i in range(90):
        hrefs = [str(rng.choice([f'href="http://{h}/p"', f"href='//{h}'", f"HREF=https://{h.upper()}/q?x", 'href="/local"', f'data-href="http://{h}"'])) for h in rng.choice(hosts, 3)]
        pages.append((i, f"http://{rng.choice(hosts)}{rng.choice(['/es/', '/de/1', '/fr/', '/en/1', '/'])}", "<a " + " x><a ".join(hrefs) + ">", "k", 1.0))
    pages += [pages[0], pages[0], (500, None, pages[1][2], "k", 2.0), (501, "http://lone.edu/", None, "k", 2.0), (None, "http://www.one.net/", "", None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, host string, score double").selectExpr("*", "1 AS rule", "2 AS trust", "3 AS src", "4 AS flow")
    host = lambda u: re.split(r"[/?#]", u.split("://", 1)[1])[0].lower() if u and "://" in u else ""
    links, names = collections.Counter(), set()
    for _, u, h, *_ in pages:
        names.add(host(u))
        for x in re.findall(r"""(?i)\shref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)""", h or ""):
            d = host("http:" + x if x.startswith("//") else x)
            names.add(d)
            if host(u) and d and d != host(u):
                links[host(u), d] += 1.0
    ties = set()
    for n in {host(u) for _, u, *_ in pages} - {"", "10.0.0.1"}:
        while n.count(".") > 1:
            up = n.split(".", 1)[1]
            ties |= {(n, up), (up, n)}
            names |= {up}
            n = up
    for t in ties:
        links[t] += 0.5
    edges = {(r["src"], r["dst"]): r["weight"] for r in urlgraph.host_edges(df).collect()}
    assert edges == dict(links)
    rows = urlgraph.judge(df, queries.URL_RULES).collect()
    by_rule = lambda r: {"org/": "allow", "com/fr/": "allow"}.get(r["rule"], "block")
    seeds = collections.defaultdict(lambda: [0, 0])
    for r in rows:
        if r["rule"] and r["host"]:
            seeds[r["host"]][by_rule(r) == "block"] += 1
    want = brute_flows([(*k, w) for k, w in links.items()], [(h, *v) for h, v in seeds.items()], sorted(names - {""}))
    assert len(rows) == len(pages)
    for r in rows:
        trust, distrust = want.get(r["host"], (0.0, 0.0))
        assert abs(r["trust"] - trust) < 2e-3 and abs(r["distrust"] - distrust) < 2e-3
        if r["rule"] or abs(distrust - trust) > 1e-3 or trust == distrust:
            assert r["verdict"] == (by_rule(r) if r["rule"] else "block" if distrust > trust else "allow")


def test_linked_to_blocked_is_blocked(spark):
    pages = spark.createDataFrame([(1, "http://bad.com/de/x", None), (2, "http://friend.net/p", '<a href="http://bad.com/q">x</a>'), (3, "http://good.org/", '<a href="http://ok.net/">x</a>'), (4, "http://ok.net/", ""), (5, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urlgraph.judge(pages, queries.URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    assert urlgraph.judge(pages.limit(0), queries.URL_RULES).count() == 0


# --- 3 near duplicates


def brute_classes(texts):
    bags = {}
    for i, t in texts.items():
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        bags[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else collections.Counter()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i in texts if bags[i]]
    holders = collections.defaultdict(list)
    for i in ids:
        for s in bags[i]:
            holders[s].append(i)
    for a, b in {(x, y) for v in holders.values() for x in v for y in v if x < y}:
        common = sum((bags[a] & bags[b]).values())
        if common >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - common):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in texts}


def test_classes_equal_brute_force(spark, sf, texts):
    got = {r["doc_id"]: r["class_id"] for r in queries.op3_bagminhash(spark, sf).collect()}
    assert got == brute_classes(texts)


def test_chain_of_near_copies_is_one_class(spark):
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        base = base[:]
        base[(i * 7) % 120] = f"x{i}"
        texts[i] = " ".join(base)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert {r["doc_id"]: r["class_id"] for r in bagminhash.near_duplicates(docs).collect()} == brute_classes(texts)


def test_cross_class_join_finds_what_stars_miss(spark):
    """The exact second step alone, started from classes of one text each."""
    rng = np.random.default_rng(0)
    common = [f"c{i}" for i in range(80)]
    texts = {i: " ".join(common + [f"u{i}x{k}" for k in range(int(rng.integers(1, 30)))]) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    names = bagminhash.sign(docs, "doc_id", "text").select("doc", "id")
    doc = {r["id"]: r["doc"] for r in names.collect()}
    bags = bagminhash.written(bagminhash._bags(docs, "doc_id", "text", names), "t")
    rest = bagminhash.written(names.selectExpr("id", "id AS root"), "t")
    got = {tuple(sorted((doc[r["a"]], doc[r["b"]]))) for r in bagminhash._across_classes(bags, rest, 0.8, 4).collect()}
    n = {i: len(t.split()) - 4 for i, t in texts.items()}
    assert got == {(a, b) for a in n for b in n if a < b and 76 >= 0.8 * (n[a] + n[b] - 76)}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = {i: int(w) for i, w in enumerate(rng.geometric(0.3, 200))}
    b = {**{i: max(1, w + int(rng.integers(-1, 2))) for i, w in a.items()}, **{1000 + i: 3 for i in range(20)}}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    found = []
    for s in range(30):
        keys = bagminhash.mix64(np.array([*a, *b], np.uint64) + np.uint64(10**6 * s))
        sig = bagminhash.signatures(2, np.repeat([0, 1], [len(a), len(b)]), keys, np.array([*a.values(), *b.values()]))
        found.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(found) - want) < 0.03


def test_only_texts_in_shared_buckets_keep_their_signatures(spark, monkeypatch):
    held, plausible = [], bagminhash._plausible

    def seen(pairs, reps, threshold):
        held.append(reps.count())
        return plausible(pairs, reps, threshold)

    monkeypatch.setattr(bagminhash, "_plausible", seen)
    texts = [" ".join(f"w{k}x{i}" for i in range(100)) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id bigint, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in bagminhash.near_duplicates(docs).collect()}
    assert held and set(held) == {2}
    assert found == {**{i: (i, 0) for i in range(1, 6)}, 0: (0, 1), 6: (0, 1)}


def test_bags_move_only_for_pairs_that_counts_leave(spark, monkeypatch):
    base = [f"w{i}" for i in range(400)]
    texts = {k: " ".join(base[: 400 - 12 * k] + [f"u{k}x{i}" for i in range(12 * k)]) for k in range(8)}
    long = [f"l{i}" for i in range(40_000)]  # too long for counts
    texts |= {20: " ".join(long), 21: " ".join([*long, "end"]), 22: " ".join(long[:20_000] + [f"m{i}" for i in range(20_000)])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    names = bagminhash.sign(docs, "doc_id", "text").select("doc", "id")
    doc = {r["id"]: r["doc"] for r in names.collect()}
    bags = bagminhash.written(bagminhash._bags(docs, "doc_id", "text", names), "t")
    rows = {doc[r["id"]]: r for r in bags.collect()}
    assert {k for k, r in rows.items() if r["cells"] is None} == {20, 21, 22}
    assert all(r["n"] == len(r["bag"]) == sum(r["cells"] or r["bag"] and [r["n"]]) for r in rows.values())
    pairs = spark.createDataFrame([(rows[a]["id"], rows[b]["id"]) for a in rows for b in rows if a > b], "a bigint, b bigint")
    share = {(a, b): len({*rows[a]["bag"]} & {*rows[b]["bag"]}) for a in rows for b in rows if a > b}
    want = {k for k, c in share.items() if c >= 0.8 * (rows[k[0]]["n"] + rows[k[1]]["n"] - c)}
    moved, written = {}, bagminhash.written
    monkeypatch.setattr(bagminhash, "written", lambda df, name, *a, **k: moved.setdefault(name, written(df, name, *a, **k)))
    monkeypatch.setattr(bagminhash, "drop_written", lambda df: None)
    assert {(doc[r["a"]], doc[r["b"]]) for r in bagminhash._similar(pairs, bags, 0.8, "x", 4).collect()} == want
    near = {(doc[r["a"]], doc[r["b"]]) for r in moved["x-near"].collect()}
    assert want <= near and {k for k in near if k[0] < 20} <= {k for k, c in share.items() if c >= 0.7 * (rows[k[0]]["n"] + rows[k[1]]["n"] - c)}
    assert {k for k in near if k[0] >= 20} == {(21, 20), (22, 20), (22, 21)} and (1, 0) in want and (7, 0) not in near


def test_links_are_grouped_once_and_sizes_come_before_signatures(spark, monkeypatch):
    """Later rounds go through their own links only, and no pair that sizes rule out is joined with signatures."""
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for i in range(60):
        base = base[:]
        base[(i * 7) % 120] = f"x{i}"
        texts[i] = " ".join(base)
        if i % 6 == 0:
            texts[100 + i] = " ".join([*base, *(f"y{i}x{k}" for k in range(60))])
    total = {i: len(t.split()) - 4 for i, t in texts.items()}
    edges, pairs_held, components, plausible = [], [], bagminhash.components, bagminhash._plausible

    def grouped(found, *a):
        edges.append(found.count())
        return components(found, *a)

    def held(pairs, reps, threshold):
        size = {r["id"]: total[r["rep"]] for r in reps.collect()}
        pairs_held.extend((size[r["a"]], size[r["b"]]) for r in pairs.collect())
        return plausible(pairs, reps, threshold)

    monkeypatch.setattr(bagminhash, "components", grouped)
    monkeypatch.setattr(bagminhash, "_plausible", held)
    monkeypatch.setattr(bagminhash, "SMALL_BUCKET", 0)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in bagminhash.near_duplicates(docs).collect()}
    assert {i: c for i, (c, _) in found.items()} == brute_classes(texts)
    assert len(edges) > 1 and 2 * sum(edges) == sum(n for _, n in found.values())
    assert pairs_held and all(min(p) >= 0.8 * max(p) for p in pairs_held)


def test_regrouped_equals_components_of_all_edges(spark):
    rng = np.random.default_rng(5)
    parts = [[(int(a), int(b)) for a, b in rng.integers(-40 - 20 * k, 40 + 20 * k, (25, 2)) if a != b] for k in range(4)]
    frames = [spark.createDataFrame(p, "a bigint, b bigint") for p in parts]
    roots = bagminhash.components(frames[0], "r", 4)
    for k in range(1, 4):
        roots = bagminhash._regrouped(roots, frames[k], f"r{k}", 4)
        whole = bagminhash.components(spark.createDataFrame(sum(parts[: k + 1], []), "a bigint, b bigint"), "w", 4)
        assert sorted(map(tuple, roots.collect())) == sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, bagminhash._regrouped(roots, frames[0].limit(0), "e", 4).collect())) == sorted(map(tuple, whole.collect()))


def test_near_duplicates_odd_rows(spark, odd_documents):
    rows = bagminhash.near_duplicates(odd_documents).collect()
    got = [(r["doc_id"], r["class_id"]) for r in rows]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 2), (None, None), (3, 3), (4, 4), (5, 5), (5, 5), (6, 5)], key=str)
    clash = spark.createDataFrame([(7, "a b c d e f g"), (7, "h i j k l m n"), (7, "h i j k l m n"), (8, "h i j k l m n"), (7, ""), (9, "a b c d e f g")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in bagminhash.one_of_each(clash).collect()) == [(7, ""), (7, "a b c d e f g"), (7, "h i j k l m n")]
    assert sorted((r["doc_id"], r["class_id"]) for r in bagminhash.near_duplicates(clash).collect()) == [(7, 7)] * 4 + [(8, 7), (9, 7)]
    assert bagminhash.one_of_each(odd_documents.limit(0)).count() == 0
    kept = bagminhash.one_of_each(odd_documents)
    assert sorted([r["doc_id"] for r in kept.collect()], key=str) == sorted([1, 2, None, 3, 4, 5], key=str) and kept.columns == odd_documents.columns
    assert bagminhash.near_duplicates(odd_documents.limit(0)).count() == 0


# --- 4 shards


def test_shards_are_even_and_gapless(spark, sf, texts):
    rows = queries.op4_hash_ring(spark, sf).toPandas()
    assert sorted(rows.doc_id) == sorted(texts)
    assert all(zlib.crc32((texts[i] or "").encode()) == c and len((texts[i] or "").encode()) + 16 == n for i, c, n in zip(rows.doc_id, rows.text_crc32, rows["size"], strict=True))
    for _, own in rows.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_shard_loads_stay_bounded(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 200 AS int)) AS text")
    loads = ring.shard_documents(docs, shards=16).groupBy("shard").agg(F.sum("size").alias("n")).toPandas().n
    assert len(loads) == 16 and loads.max() < 1.01 * loads.mean() and loads.min() > 0.97 * loads.mean()


def test_few_keys_move_from_the_plain_ring():
    at, owner = ring.ring_points(16)
    loads = np.full(len(at), 1000)
    parts = ring.settle(loads, owner, 16, 0.001)
    assert sum(b - a for _, a, b, _ in parts) == loads.sum()
    assert sum(b - a for arc, a, b, s in parts if s != owner[arc]) < 0.08 * loads.sum()


def test_settle_equals_a_plain_ring_walk():
    """Unit keys walked one by one, first each to its own point, then what is left clockwise to shards with room."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        shards, arcs = 4, 24
        owner, loads = rng.integers(0, shards, arcs), rng.integers(0, 30, arcs) * (rng.random(arcs) < 0.8)
        owner[:shards] = range(shards)
        room = np.full(shards, int(1.05 * loads.sum() / shards + 1))
        homes, late = {}, []
        free = np.full(shards, (1 + 0.05) * loads.sum() / shards)
        for arc in range(arcs):
            for k in range(int(loads[arc])):
                if free[owner[arc]] >= 1:
                    homes[arc, k] = owner[arc]
                    free[owner[arc]] -= 1
                else:
                    late.append((arc, k))
        for arc, k in late:
            at = next((i for i in range(arc + 1, arc + arcs + 1) if free[owner[i % arcs]] >= 1), None)
            shard = owner[at % arcs] if at is not None else int(free.argmax())
            homes[arc, k] = shard
            if at is not None:
                free[shard] -= 1
        got = {(arc, k): s for arc, a, b, s in ring.settle(loads, owner, shards, 0.05) for k in range(a, b)}
        assert got == homes and room.min() > 0


def test_one_more_shard_moves_few_bytes(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 200 AS int)) AS text")
    before, after = (ring.shard_documents(docs, shards=n).select("doc_id", "size", F.col("shard").alias(f"s{n}")) for n in (40, 41))
    moved = before.join(after.drop("size"), "doc_id").groupBy().agg(F.sum(F.when(F.col("s40") != F.col("s41"), F.col("size"))) / F.sum("size")).first()[0]
    assert moved < 0.25  # 1 / 41 goes to the new shard; the rest moves because every shard is filled to the last half per mille


def test_equal_rows_are_spread(spark):
    docs = spark.range(6000).selectExpr("if(id < 4000, 7, id) AS doc_id", "if(id < 4000, 'the same text', cast(id AS string)) AS text")
    rows = ring.shard_documents(docs, shards=8).toPandas()
    loads = rows.groupby("shard")["size"].sum()
    assert len(rows) == 6000 and len(loads) == 8 and loads.max() < 1.02 * loads.mean()
    assert all(sorted(own.slot) == list(range(len(own))) for _, own in rows.groupby("shard"))


def test_shards_odd_rows(spark, odd_documents):
    rows = ring.shard_documents(odd_documents, shards=3).collect()
    assert len(rows) == 8 and {r["shard"] for r in rows} <= {0, 1, 2}
    assert ring.shard_documents(odd_documents.limit(0), shards=3).count() == 0


# --- 5 toxicity


def edits(a, b):
    """Optimal string alignment distance."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


TERMS = ["idiot", "moron", "worthless", "scum", "disgusting", "clown", "abcd", "abcde"]
AUTOMATON = toxicity.LexiconAutomaton(TERMS, ["vequ"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("abcdeiotmnrscuw", max_size=12), st.builds(lambda t, i, c: t[:i] + c + t[i + 1 :], st.sampled_from(TERMS), st.integers(0, 9), st.text("abio", max_size=2))))
def test_automaton_equals_edit_distance(word):
    fits = [edits(t, word) for t in TERMS if edits(t, word) <= toxicity.allowed_edits(len(t))]
    assert AUTOMATON.match(word) == min(fits, default=None)


def test_stems_misspellings_and_quotations():
    assert AUTOMATON.match("vequaire") == 0 and AUTOMATON.match("requaire") is None
    found = toxicity.hits('You id1ot! He said "moron" twice. A wrothless thing', AUTOMATON, {})
    assert [(e, q) for _, _, e, q in found] == [(1, False), (0, True), (1, False)]


def test_stems_forgive_edits():
    automaton = toxicity.LexiconAutomaton([], ["idiot", "vequ"])
    assert [automaton.match(w) for w in ("idiotic", "idoits", "idiiots", "idotic", "odiotic", "iditos", "vequaire")] == [0, 1, 1, 1, 1, 1, 0]
    assert [automaton.match(w) for w in ("idiom", "idiosyncratic", "idio", "idxxtic", "veqaire", "idiot", "vequ")] == [None] * 7
    both = toxicity.LexiconAutomaton(["idiot", "idiotic"], ["idiot"])
    assert [both.match(w) for w in ("idiof", "idioic", "idiotx", "idiot")] == [1, 1, 0, 0]


def stem_edits(stem, head):
    """Edits of a word's head (which goes on after it) whose last step is the stem's last character, alone or swapped with the one before."""
    same = [edits(stem[:-1], head[:-1])] if stem[-1] == head[-1] else []
    swapped = [edits(stem[:-2], head[:-2]) + 1] if len(head) > 1 and stem[-2:] == head[-2:][::-1] and stem[-1] != stem[-2] else []
    return min(same + swapped, default=None)


@settings(max_examples=300, deadline=None)
@given(st.builds(lambda t, i, n, c, end: t[:i] + c + t[i + n :] + end, st.sampled_from(["idiot", "moron", "vequ"]), st.integers(0, 5), st.integers(0, 2), st.text("idomrnvequt", max_size=2), st.text("idomrnt", max_size=3)))
def test_stems_equal_edit_distance(word):
    stems = ["idiot", "moron", "vequ"]
    fits = [(stem_edits(s, word[:n]), toxicity.allowed_edits(len(s))) for s in stems for n in range(1, len(word))]
    fits = [e for e, most in fits if e is not None and e <= most]
    assert toxicity.LexiconAutomaton([], stems).match(word) == min(fits, default=None)


def test_toxicity_odd_rows(spark, odd_documents):
    model = toxicity.ToxicityModel(AUTOMATON, np.array(toxicity.PRIOR))
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == 8 and len({r["score"] for r in rows}) == 1 and rows[0]["score"] < 0.3
    assert toxicity.keep_below(odd_documents, model, 0.3).count() == 8
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(odd_documents, labels, order=F.xxhash64("doc_id")).automaton.words == []


def test_toxicity_learns_planted_terms(spark):
    rng = np.random.default_rng(5)
    clean = ["the", "stone", "river", "walks", "under", "green", "light", "and", "softly"]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(clean, 30))
        toxic = i % 8 == 0
        if toxic:
            words[5] = "idiot"
            words[9] = "lowei" + str(rng.choice(["ent", "ung", "ach"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, marks, order=F.xxhash64("doc_id"))
    assert "idiot" in model.automaton.words
    new = spark.createDataFrame([(1, "you idoit river"), (2, "the stone walks softly"), (3, "loweiheit under green")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(new, model).collect()}
    assert got[1] > 0.3 > got[2] and got[3] > 0.3


def test_quotations_are_told_from_abuse(spark):
    """Terms that clean documents quote as often as toxic ones use them are learned, and so are weights that tell the two apart."""
    rng = np.random.default_rng(8)
    clean = [a + b for a in ("sto", "riv", "wal", "gre", "lig", "sof", "mil", "pan") for b in ("ne", "er", "ks", "en", "ht", "tly")]
    rows = []
    for i in range(1200):
        words = list(rng.choice(clean, 30))
        if i % 8 == 0:
            words[int(rng.integers(30))] = "idiot"
        if i % 8 == 1:
            words[int(rng.integers(30))] = '"idiot"'
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.where("doc_id % 3 > 0"), docs.where("doc_id % 3 > 0"), order=F.xxhash64("doc_id"))
    assert model.automaton.words == ["idiot"] and model.weights[2] - model.weights[4] > 2
    got = {r["doc_id"]: r for r in toxicity.score(docs.where("doc_id % 3 = 0"), model).collect()}
    assert all((got[i]["score"] >= 0.3) == bool(t) for i, _, t in rows if i % 3 == 0) and sum(r["n_quoted"] for r in got.values()) == 50


def brute_quoted(text, start, end):
    """Whether a quotation is open from before `start` to after `end`, the paragraph read from its beginning a character at a time."""
    first = max((m.end() for m in re.finditer(r"\n\s*\n", text[:start])), default=0)
    mark = None
    for i in range(first, len(text)):
        c, before, after = text[i], text[i - 1] if i else "", text[i + 1] if i + 1 < len(text) else ""
        if i >= end and re.match(r"\n\s*\n", text[i:]):
            return False
        if mark is not None and c in toxicity.QUOTES[mark[0]] and not before.isspace() and not after.isalnum():
            if i >= end:
                return mark[1] < start
            mark = None
        elif mark is None and c in toxicity.QUOTES and not before.isalnum() and after and not after.isspace():
            mark = c, i
    return False


@pytest.mark.parametrize(
    ("text", "quoted"),
    [
        ("You are an idiot and you do not know it", 0), ("You’re an idiot and you don’t know it", 0), ("It’s you, idiot, and that’s it", 0), ('"Hi" she smiled. You idiot. "Bye"', 0), ("this term idiot", 0), ("the word idiot", 0),
        ('a stray " mark, you idiot', 0), ('a stray " mark, you idiot" end', 0), ('"unclosed you idiot', 0), ('he wrote "you idiot" there', 1), ("sie sagt „du idiot“ oft", 1), ("« idiot »", 0), ("«idiot»", 1), ("»idiot«", 1), ("‘you idiot’", 1), ("they said idiot", 1),
        ('"you\nidiot" over a line', 1), ('"open\n\nidiot" in another paragraph', 0), ('"' + "long " * 200 + 'idiot"', 1), ("''idiot''", 0), ("`idiot`", 1),
    ],
)
def test_marks_are_paired_and_apostrophes_are_none(text, quoted):
    automaton = toxicity.LexiconAutomaton(["idiot"], [])
    (hit,) = toxicity.hits(text, automaton, {})
    assert hit[3] == bool(quoted)
    assert brute_quoted(text, hit[0], hit[1]) == (bool(quoted) and "said" not in text)
    assert ("idiot" in toxicity.without_quotations(text)) == (not quoted or "said" in text)


def brute_hits(text, model):
    """(start, end, edits, quoted) by edit distances to every term, without automaton or memo."""
    out, low = [], text.lower()
    text = low if len(low) != len(text) else text
    for m in toxicity.WORD.finditer(low):

        def least(w):
            fits = [edits(t, w) for t in model.automaton.words if edits(t, w) <= toxicity.allowed_edits(len(t))]
            for s in model.automaton.stems:
                near = [stem_edits(s, w[:n]) for n in range(1, len(w))]
                fits += [e for e in near if e is not None and e <= toxicity.allowed_edits(len(s))]
            return min(fits, default=None)

        word, folded = m.group(), m.group().translate(toxicity.LEET)
        found = least(word)
        if found is None and not word.isalpha() and folded.isalpha():
            found = least(folded)
            found = found if found is None else max(1, found)
        if found is None or (found and word in model.automaton.exceptions):
            continue
        told = brute_quoted(text, m.start(), m.end()) or any(w in toxicity.REPORTING for w in toxicity.WORD.findall(text[max(0, m.start() - 48) : m.start()].lower())[-2:])
        out.append((m.start(), m.end(), found, told))
    return out


def test_scores_equal_brute_force(spark, texts):
    model = toxicity.ToxicityModel(toxicity.LexiconAutomaton(["idiot", "scum", "pathetic"], ["vequ", "achlich"], frozenset(["idiom"])), np.array(toxicity.PRIOR))
    some = {i: (t or "")[:400] for i, t in list(texts.items())[:60]}
    some |= {10**6: 'He wrote "idiot" and you id1ot idiom pathatic', 10**6 + 1: "said scum. «achlichung» but vequa equx", 10**6 + 2: ""}
    docs = spark.createDataFrame(list(some.items()), "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        found = brute_hits(some[r["doc_id"]], model)
        direct, quoted = (sum(0.8**e for *_, e, q in found if q == told) for told in (False, True))
        plain = any(e == 0 and not q for *_, e, q in found)
        x = [np.log1p(direct), np.log1p(quoted), float(plain), 0.0 if plain else min(1.0, direct), min(1.0, quoted), 1.0]
        assert r["n_hits"] == len(found) and r["n_quoted"] == sum(q for *_, q in found)
        assert abs(r["score"] - 1 / (1 + np.exp(-np.dot(x, toxicity.PRIOR)))) < 1e-9


@pytest.mark.parametrize("changed", [0, 1])
def test_hot_copies_neither_drop_nor_add_terms(spark, changed):
    rng = np.random.default_rng(6)
    vocabulary = [a + b for a in ("sto", "riv", "wal", "gre", "lig", "sof", "mil", "pan") for b in ("ne", "er", "ks", "en", "ht", "tly")]
    rows = []
    for i in range(400):
        words = list(rng.choice(vocabulary, 30))
        if i % 8 == 0:
            words[5] = "idiot"
        rows.append((" ".join(words), int(i % 8 == 0)))
    hot = [f"{a}{b}um" for a in ("bre", "cli", "dro", "fla", "gru") for b in ("vx", "zk", "pt", "nd", "lm", "rg", "st", "kk")]
    hot = [x for pair in zip(hot, list(rng.choice(vocabulary, 40)), strict=True) for x in pair] + ["idiot"]
    for _ in range(450):
        words = list(hot)
        for _ in range(changed):
            words[int(rng.integers(80))] = str(rng.choice(vocabulary))
        rows.append((" ".join(words), 1))
    sample = spark.createDataFrame(rows, "text string, label int")
    words, stems = toxicity.learn_lexicon(sample)
    assert words == ["idiot"] and stems == []


# --- tokens, 6 records, 7 packing

ODD_TEXTS = ["", " ", "a  b", "\n\na\n b \n", " lead", "trail ", "tab\tx y", "x\n\ny", "don't  stop now   x", "a\x1cb c", "é ́ a", "<|endoftext|> x", "İ I", "x'll 'll y's 's", "  \n  ", "ÄÖ ß ΑΣ\0x"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_whole_texts(texts, name):
    encoder = PieceEncoder(queries.tokenizer_path(name))
    every = [t or "" for t in texts.values()] + ODD_TEXTS
    offsets, ids = encoder.encode(every)
    for i, e in enumerate(encoder.tokenizer.encode_batch_fast(every, add_special_tokens=False)):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == e.ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab 'sé\n\t.~", max_size=20), max_size=5))
def test_pieces_of_any_text(rows):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = ENCODERS.setdefault(name, PieceEncoder(queries.tokenizer_path(name)))
        offsets, ids = encoder.encode(rows)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [encoder.tokenizer.encode(r, add_special_tokens=False).ids for r in rows]


ENCODERS: dict = {}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_small_memo_forgets_without_a_trace(monkeypatch, name):
    from larder.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_PIECES", 40)
    monkeypatch.setattr(tokens, "MEMO_LONG_CHARS", 100)
    encoder, rng = PieceEncoder(queries.tokenizer_path(name)), np.random.default_rng(2)
    words = ["the", "The", "the,", "the.", "thing...", "x's", "x,y", "don't", "Ünder.", "word", "word,", "w" * 60, "1,", "a.b.", "é.", "stop.\nNew", "\t"]
    for _ in range(60):
        rows = [" ".join(rng.choice(words, 12)) + f" n{int(rng.integers(400))}." for _ in range(5)]
        offsets, ids = encoder.encode(rows)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [encoder.tokenizer.encode(r, add_special_tokens=False).ids for r in rows]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_piece_is_looked_up_once_for_all_its_places(name):
    encoder, looked = PieceEncoder(queries.tokenizer_path(name)), []

    class Index(type(encoder.index)):
        def __getitem__(self, key):
            looked.append(key)
            return super().__getitem__(key)

    rows = ["the sea the sea\nthe sea", "", "a  gap\u2003and a\0zero", "the sea " * 50 + "the end", " the sea", "\n", "The SEA"]
    encoder.index = Index()
    offsets, ids = encoder.encode(rows)
    assert len(looked) == len(set(looked)) < 40
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [encoder.tokenizer.encode(r, add_special_tokens=False).ids for r in rows]


def test_records_round_trip(spark, sf, texts, tmp_path):
    folder, path = str(tmp_path / "rec"), queries.tokenizer_path("word_bpe_49k.json")
    index = records.write_records(spark.read.parquet(f"{sf}/documents.parquet"), folder, path, parts=3)
    rows = records.read_records(spark, folder, index).orderBy("start").collect()
    tokenizer = PieceEncoder(path).tokenizer
    start = 0
    for r, i in zip(rows, sorted(texts), strict=True):
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    entries = [(r["part"], r["width"], r["position"], r["payload"], r["doc_id"], r["n_tokens"]) for r in index.orderBy(F.rand(3)).limit(20).collect()]
    for (doc, ids), e in zip(records.fetch(folder, [e[:4] for e in entries]), entries, strict=True):
        assert (doc, len(ids)) == e[4:]


def test_damaged_records_are_found(spark, tmp_path):
    folder = str(tmp_path / "rec")
    index = records.write_records(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), folder, queries.tokenizer_path("word_bpe_49k.json"), parts=1)
    part = next(f for f in (tmp_path / "rec").iterdir() if f.suffix == ".rec")
    data = bytearray(part.read_bytes())
    data[20] ^= 1
    part.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged payload"):
        records.read_records(spark, folder, index).collect()


def test_records_odd_rows(spark, odd_documents, tmp_path):
    path = queries.tokenizer_path("word_bpe_49k.json")
    index = records.write_records(odd_documents, str(tmp_path / "a"), path, parts=2)
    rows = records.read_records(spark, str(tmp_path / "a"), index).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 5, 6] and rows[1]["n_tokens"] == rows[2]["n_tokens"] == 1
    index = records.write_records(odd_documents.limit(0), str(tmp_path / "b"), path, parts=2)
    assert records.read_records(spark, str(tmp_path / "b"), index).count() == 0


def test_hot_ids_lie_in_several_parts(spark, tmp_path):
    docs = spark.range(3000).selectExpr("if(id < 2900, 5, id) AS doc_id", "if(id < 1500, 'equal words', concat('words ', id)) AS text").repartition(6)
    index = records.write_records(docs, str(tmp_path / "hot"), queries.tokenizer_path("word_bpe_49k.json"), parts=6)
    assert index.where("doc_id = 5").select("part").distinct().count() > 3
    rows = records.read_records(spark, str(tmp_path / "hot"), index).orderBy("start").collect()
    assert len(rows) == 3000 and [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def check_packing(rows, texts, tokenizer):
    for doc, own in rows.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = own.sort_values("start"), 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 1024


def test_packing_is_exact_and_tight(spark, sf, texts):
    rows = queries.op7_sum_of_squares(spark, sf).toPandas()
    check_packing(rows, texts, PieceEncoder(queries.tokenizer_path("byte_bpe_50k.json")).tokenizer)
    assert rows.length.sum() / (1024 * rows.sequence_id.nunique()) > 0.85


def test_packer_wastes_little():
    packer, sizes = packing.SumOfSquares(1024), np.random.default_rng(6).integers(1, 1024, 8000)
    placed = [packer.place(int(s)) for s in sizes]
    number, shift = packer.close()
    held = collections.defaultdict(list)
    for (at, offset), s in zip(placed, sizes, strict=True):
        held[number[at]].append((offset + shift[at], s))
    for pieces in held.values():
        pieces.sort()
        assert all(o == sum(s for _, s in pieces[:k]) for k, (o, _) in enumerate(pieces)) and sum(s for _, s in pieces) <= 1024
    assert sorted(held) == list(range(len(held))) and sizes.sum() / (1024 * len(held)) > 0.93


def test_equal_rows_are_dealt_over_blocks(spark):
    docs = spark.range(4000).selectExpr("if(id < 3000, null, id) AS doc_id", "'one and the same text' AS text").repartition(4)
    rows = packing.pack(docs, queries.tokenizer_path("byte_bpe_50k.json"), block_rows=500).toPandas()
    blocks = (rows.sequence_id // 2**32).value_counts()
    assert len(rows) == 4000 and len(blocks) == 8 and blocks.max() < 800


def test_packing_odd_rows(spark, odd_documents):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(odd_documents, path).toPandas()
    assert len(rows.doc_tokens) >= 8 and set(rows[rows.doc_id.isin([1, 2])].length) == {1}
    assert packing.pack(odd_documents.limit(0), path).count() == 0


# --- 8 quality


def test_measures_equal_brute_force(spark, sf, texts):
    for r in queries.op8_line_frequency(spark, sf).collect():
        t = texts[r["doc_id"]] or ""
        w = WORDS.findall(t)
        seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        full = [x for x in t.split("\n") if WORDS.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r["kept"] and r["base_failed"])


def test_shared_lines_deplete_a_document(spark):
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits would be normalised away
    own = lambda i: f"unique words number {name(i)} " + " ".join(f"t{name(i)}x{name(k)}" for k in range(12))
    rows = [(i, f"Subscribe to our daily letter now {i}\n{own(i)}", "a") for i in range(30)] + [(100, "Subscribe to our daily letter now 7\nshort rest of it all here", "a"), (101, "Subscribe to our daily letter now 7\n" + own(101), "b"), (102, "subscribe to  our daily letter now 5\nsubscribe to our daily LETTER now 6\nand x y z", "a")]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in lines.quality(docs, line_limit=20, least_left=0.5).collect()}
    assert all(got[i]["kept"] and got[i]["n_boilerplate_chars"] > 30 for i in range(30))
    assert not got[100]["kept"] and got[101]["kept"] and got[101]["n_boilerplate_chars"] == 0 and not got[102]["kept"]
    assert lines.quality(docs, line_limit=32).where("n_boilerplate_chars > 0").count() == 0


def test_line_limit_grows_with_the_host_and_copies_count_once(spark):
    letters = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    own = lambda i: " ".join(f"t{letters(i)}x{letters(k)}" for k in range(12))
    line = "an ordinary short line that some documents of a large host happen to share"
    large = [(i, f"{line}\n{own(i)}" if i % 25 == 0 else own(i), "large") for i in range(1000)]
    boilerplate = [(i, f"{line}\n{own(i)}", "small") for i in range(2000, 2030)]
    copies = [(i, f"{line}\n{own(3000)}", "copied") for i in range(3000, 3040)] + [(4000, own(4000), "copied")]
    got = {r["doc_id"]: r for r in lines.quality(spark.createDataFrame(large + boilerplate + copies, "doc_id long, text string, source string")).collect()}
    assert not any(got[i]["n_boilerplate_chars"] for i, *_ in large + copies)
    assert all(got[i]["n_boilerplate_chars"] == len(line) for i, *_ in boilerplate)


def test_verdicts_of_lines_equal_brute_force(spark):
    """Random documents of a small pool of lines, hosts of unlike sizes, copies under other ids."""
    rng = np.random.default_rng(9)
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))
    pool = [" ".join(f"{name(i)}q{name(k)}" for k in range(int(rng.integers(3, 9)))) for i in range(40)]
    rows = []
    for i in range(400):
        own = [f"u{name(i)} " + " ".join(f"v{name(i)}x{name(k)}" for k in range(int(rng.integers(2, 12))))]
        text = "\n".join(rng.permutation(list(rng.choice(pool, int(rng.integers(0, 6)), p=np.arange(40, 0, -1) / 820)) + own))
        rows.append((i, text, "abbcccc"[i % 7]))
    rows += [(1000 + i, rows[3][1], "a") for i in range(30)]
    norm = lambda x: re.sub(r"\d+", "0", " ".join(x.lower().split()))
    texts = collections.defaultdict(set)
    for _, t, h in rows:
        texts[h].add(t)
    held = {h: collections.Counter(x for t in ts for x in {norm(y) for y in t.split("\n") if y.strip()}) for h, ts in texts.items()}
    got = {r["doc_id"]: r for r in lines.quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), line_limit=5, line_share=0.04, least_left=0.6).collect()}
    assert len({r["kept"] for r in got.values()}) == 2
    for i, t, h in rows:
        full = [y for y in t.split("\n") if y.strip()]
        gone = sum(len(y) for y in full if held[h][norm(y)] > max(5, 0.04 * len(texts[h])))
        kept = not got[i]["base_failed"] and (not gone or sum(map(len, full)) - gone >= 0.6 * sum(map(len, full)))
        assert (got[i]["n_boilerplate_chars"], got[i]["kept"]) == (gone, kept)


def test_quality_odd_rows(spark, odd_documents):
    rows = lines.quality(odd_documents).collect()
    assert len(rows) == 8 and not any(r["kept"] for r in rows)
    assert lines.quality(odd_documents.limit(0)).count() == 0


# --- 9 top k


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(7)
    v = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(300)] + [(i, [0.5] * 6) for i in range(300, 400)]
    v += [(400, None), (401, [0.1, None] * 3), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (None, [0.5] * 6), (404, [0.5] * 5), (440, [0.25] * 5)]
    rows = topk.integer_vectors(spark.createDataFrame(v, "vec_id long, embedding array<float>"))
    got = collections.defaultdict(list)
    for r in topk.top_k(rows, rows.where("id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    fine = {i: np.floor(64 * np.array(x)) for i, x in v[:400]} | {i: np.floor(64 * np.array(x)) for i, x in v[-2:]}
    for q in (i for i in fine if i % 20 == 0):
        want = sorted(((int(fine[q] @ fine[i]), i) for i in fine if i != q and len(fine[i]) == len(fine[q])), key=lambda x: (-x[0], x[1]))[:20]
        assert got[q] == [(i, s) for s, i in want]
    assert topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_large_integers_stay_exact(spark):
    """Products beyond the 53 bits of a double are told apart; beyond 64 bits they are refused."""
    rng = np.random.default_rng(11)
    v = [(0, [3e7, 1 / 64]), (1, [3e7, 1 / 64]), (2, [3e7, 2 / 64]), (3, [-3e7, 0.0]), (3, [-3e7, 0.0])] + [(i, [float(x) for x in rng.integers(-(10**6), 10**6, 2)]) for i in range(4, 40)]
    rows = topk.integer_vectors(spark.createDataFrame(v, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v", "3 AS score", "4 AS query"))
    exact = [(i, [int(np.floor(64 * c)) for c in x]) for i, x in v]
    for q in (0, 20):
        own = next(x for i, x in exact if i == q)
        want = sorted(((sum(a * b for a, b in zip(own, x, strict=True)), i) for i, x in exact if i != q), key=lambda x: (-x[0], x[1]))[:20]
        got = topk.top_k(rows, rows.where(F.col("id") == q), k=20).orderBy("rank").collect()
        assert [(r["score"], r["vec_id"]) for r in got] == want
    big = topk.integer_vectors(spark.createDataFrame([(0, [4e9, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>"))
    with pytest.raises(ValueError, match="64 bits"):
        topk.top_k(big, big)


def test_queries_in_several_chunks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = topk.integer_vectors(spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(200)], "vec_id long, embedding array<double>"))
    whole = sorted(map(tuple, topk.top_k(rows, rows.where("id % 5 = 0"), k=3).collect()))
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    assert sorted(map(tuple, topk.top_k(rows, rows.where("id % 5 = 0"), k=3).collect())) == whole and len(whole) == 120


# --- 10 mixing


def test_raked_weights_meet_their_targets(spark):
    rows = [(s, lang, t, int(100 * (1 + i) ** 1.5)) for i, (s, lang, t) in enumerate((s, lang, t) for s in "abc" for lang in ("en", "fr") for t in ("x", "y"))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens bigint")
    raked = mixing.rake(cells, ["source", "lang", "topic"], power=0.5, rounds=12).toPandas()
    total = raked.tokens.sum()
    assert abs(raked.weight.sum() - total) < 1e-6 * total
    for d in ("source", "lang", "topic"):
        share = (raked.groupby(d).tokens.sum() / total) ** 0.5
        assert np.allclose(raked.groupby(d).weight.sum() / total, share / share.sum(), rtol=1e-4)


def test_kept_tokens_meet_the_stated_share(spark, sf):
    rows = queries.op10_raked_mix(spark, sf).toPandas()
    assert rows.probability.between(0, 1).all() and (rows.probability * rows.tokens).sum() == pytest.approx(mixing.KEPT_SHARE * rows.tokens.sum(), rel=1e-6)
    c = (rows.probability / rows.rate)[rows.probability < 1]
    assert np.allclose(c, c.iloc[0], rtol=1e-5) and (rows.rate * c.iloc[0] >= 1)[rows.probability == 1].all()


def test_topics(spark):
    texts = ["Released under the MIT License.", "write to a@b.org or phone", "token = 1 at http://x", "licence and password and secret", "plain words", "12 34 56", "a | b", "", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(mixing.topic(F.col("t"))).collect()
    assert [r[0] for r in got] == ["legal", "contact", "technical", "technical", "prose", "figures", "markup", "empty", "empty"]


def test_mixing_odd_rows(spark, odd_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == 8 and all(0 < r["probability"] <= 1 for r in rows)
    assert mixing.mixed_documents(odd_documents).columns == odd_documents.columns
    assert mixing.mix(odd_documents.limit(0)).count() == 0


def test_a_rare_cell_does_not_shrink_the_mix(spark):
    rows = [(i, f"some words of a document {'x' * (i % 7)}", "en", "ab"[i % 2]) for i in range(2000)] + [(5000, "12 34 56 78", "fr", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken = mixing.mixed_documents(docs).groupBy("doc_id").count().collect()
    mix = mixing.mix(docs).collect()
    rate = {r["doc_id"]: r["rate"] for r in mix}
    assert abs(sum(r["tokens"] * r["kept"] for r in mix) / sum(r["tokens"] for r in mix) - mixing.KEPT_SHARE) < 0.03
    assert len(taken) > 0.95 * len(rows) and abs(sum(r["count"] for r in taken) - sum(rate.values())) < 0.02 * len(rows)
    assert all(int(rate[r["doc_id"]]) <= r["count"] <= int(rate[r["doc_id"]]) + 1 for r in taken) and rate[5000] > 2
