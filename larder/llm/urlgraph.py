"""URL filters: suffix rules, and trust that flows along the links between hosts.

Hosts with allowed pages are trusted seeds, hosts with blocked pages are distrusted seeds.  Personalised PageRank carries
trust along links, and distrust against them (who links to a bad host is suspect).  A host whose distrust outweighs its
trust is blocked; rules come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

DAMPING = 0.85
#: Rounds end when a block of them adds less than this share of a flow's mass.
TOLERANCE = 1e-3
ROUNDS_A_BLOCK = 8
MOST_BLOCKS = 20
#: Fixed value: a longer name is no host name of the internet, and is tied to nothing.
HOST_CHARS = 253
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1))
    return F.translate(F.coalesce(rest, F.lit("")), A_TO_Z, A_TO_Z.lower())


def path_of(url: Column) -> Column:
    """What stands after the host up to ?, # or the end; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring_index(_after(url), "?", 1), "#", 1))
    return F.coalesce(F.when(F.instr(rest, "/") > 0, F.substring(rest, F.instr(rest, "/"), F.length(rest))), F.lit(""))


def _after(url: Column) -> Column:
    return F.substring(url, F.instr(url, "://") + 3, F.length(url))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of a bounded list of (verdict, host, path) rules that fits; null where none does."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def links_of(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): one row per absolute link between different hosts in the pages' href attributes; a relative one stays on its host."""
    links = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"""(?i)\shref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    out = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("l"))
    out = out.select("src", host_of(F.when(F.col("l").startswith("//"), F.concat(F.lit("http:"), "l")).otherwise(F.col("l"))).alias("dst"))
    return out.where("src <> dst and src <> '' and dst <> ''")


def domain_ties(hosts: DataFrame) -> DataFrame:
    """(src, dst) both ways for each host and the domain above it, for that domain and the one above, down to two labels."""
    named = hosts.where((F.length("host") <= HOST_CHARS) & ~F.col("host").rlike("[.:][0-9]*$")).select(F.split("host", "[.]").alias("labels"))
    chain = F.transform(F.sequence(F.lit(1), F.size("labels") - 1), lambda i: F.array_join(F.slice("labels", i, F.size("labels") - i + 1), "."))
    pairs = named.where(F.size("labels") > 2).select(chain.alias("c")).select(F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    up = pairs.select(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).where("src <> '' and dst <> ''").distinct()
    return up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def host_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, counted, and domain ties with half a link's weight, by which sister hosts reach each other."""
    real = links_of(pages, url_col=url_col, html_col=html_col).groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).where("host <> ''").distinct()
    tied = domain_ties(hosts).withColumn("weight", F.lit(0.5))
    return real.unionByName(tied).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, *, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) by personalised PageRank; seeds: (host, trusted, distrusted) non-negative seed weights.

    Both flows are one table keyed by (host, flow), so a round is one join with the edges and one aggregation; scores only grow from round to
    round.  A host without links sends its mass back to the seeds: that is the same as losing it
    and scaling each flow to one at the end, which is done.  A flow without seeds is nowhere.
    """
    flows = edges.select(F.lit("trust").alias("flow"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("flow"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = flows.groupBy("flow", "src").agg(F.sum("weight").alias("total"))
    flows = written(flows.join(out, ["flow", "src"]).select("flow", "src", "dst", (F.col("weight") / F.col("total")).alias("share")), "flows")
    starts = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trusted").cast("double"), F.lit("distrust"), F.col("distrusted").cast("double"))).alias("flow", "seed")).where("seed > 0")
    starts = written(starts, "seeds")
    sums = {r["flow"]: r["s"] for r in starts.groupBy("flow").agg(F.sum("seed").alias("s")).collect()}  # two rows
    unit = F.when(F.col("flow") == "trust", F.lit(sums.get("trust", 1.0))).otherwise(F.lit(sums.get("distrust", 1.0)))
    starts = starts.select("host", "flow", ((1 - damping) * F.col("seed") / unit).alias("score"))
    state, mass = written(starts, "ranks"), {}
    for block in range(MOST_BLOCKS):
        after = state
        for _ in range(ROUNDS_A_BLOCK):
            moved = after.withColumnRenamed("host", "src").join(flows, ["flow", "src"]).select(F.col("dst").alias("host"), "flow", (damping * F.col("score") * F.col("share")).alias("score"))
            after = moved.unionByName(starts).groupBy("host", "flow").agg(F.sum("score").alias("score"))
        after = written(after, f"ranks-{block}")
        drop_written(state)
        state, before = after, mass
        mass = {r["flow"]: r["s"] for r in state.groupBy("flow").agg(F.sum("score").alias("s")).collect()}  # two rows
        rest = damping**ROUNDS_A_BLOCK / (1 - damping**ROUNDS_A_BLOCK)  # of what this block has added can still be added
        if all((m - before.get(f, 0.0)) * rest <= tolerance * m for f, m in mass.items()):
            break
    pick = {f: F.coalesce(F.sum(F.when(F.col("flow") == f, F.col("score") / F.lit(mass.get(f, 1.0)))), F.lit(0.0)).alias(f) for f in ("trust", "distrust")}
    return state.groupBy("host").agg(pick["trust"], pick["distrust"])


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tolerance: float = 1.0) -> DataFrame:
    """Per page: id, host, path, rule, verdict, trust, distrust.

    The verdict is the rule's; without one, 'block' if the host's distrust exceeds tolerance * trust, else 'allow' (so
    for an empty host, or one that no flow reaches: both are 0 there).  A null id or url does not matter; repeated pages are
    judged alike, and their links count again; null and very long html are read whole; an empty table gives no row; other
    columns are not read, whatever their names.
    """
    url = F.col(url_col)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col).alias("__id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    seeds = judged.where("by_rule is not null and host <> ''").groupBy("host").agg(F.count_if(F.col("by_rule") == "allow").alias("trusted"), F.count_if(F.col("by_rule") == "block").alias("distrusted"))
    ranks = propagate(host_edges(pages, url_col=url_col, html_col=html_col), seeds)
    suspect = F.coalesce(F.col("distrust"), F.lit(0.0)) > F.lit(tolerance) * F.coalesce(F.col("trust"), F.lit(0.0))
    return judged.join(ranks, "host", "left").select(F.col("__id").alias(id_col), "host", "path", "rule", F.coalesce("by_rule", F.when(suspect, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
