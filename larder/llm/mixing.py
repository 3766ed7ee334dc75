"""Mixing sources to target weights by iterative proportional fitting (raking), in DataFrame operations only.

Token counts per cell (a combination of marginal columns) are scaled, one marginal after another, until the weighted
tokens of every marginal's values match its targets.  A cell's rate is its weight over its tokens; the mean rate is 1.

mix() samples without copies: a document is kept with the chance min(1, c * rate), and c is solved so that a stated share
of the tokens stays; no cell, however rare, fixes the scale.  mixed_documents() samples with copies: each document `rate`
times in expectation (whole copies, and one more by a hash of its id), so that the marginals are met whatever the rates are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

ROUNDS = 8
#: Raking stops when no weight changes by more than this share; rounds beyond it change nothing that can be seen.
RESIDUAL = 1e-13
KEPT_SHARE = 0.75
BROADCAST_CELLS = 20_000
DIMS = ("source", "lang", "topic")
WORDS = r"[^\x20\x09-\x0D]+"
# Terms that tell a topic, looked for in the lower-case text.
TOPICS = {
    "legal": ("license", "licence", "copyright", "warranty", "liability", "all rights reserved", "terms of use"),
    "technical": ("token =", "password", "api_key", "secret", "function", "import ", "return ", "http://", "https://", "www."),
    "contact": ("@", "phone", "e-mail", "address:", "contact"),
}


def token_count(text: Column) -> Column:
    """Words of a text and an end mark; 1 for null and empty texts."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint") + 1


def topic(text: Column, topics: Mapping[str, Sequence[str]] = TOPICS) -> Column:
    """The topic with the most terms in the text (the first of equal ones); without a term, the text's form.

    Forms: 'markup' (over 5 % of # * $ % & | < >), 'figures' (over 5 % digits), 'prose', or 'empty' for null and empty texts.
    """
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    low = F.lower(t)
    hits = F.array(*[sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) for words in topics.values()])
    best = F.array_max(hits)
    marks, digits = n - F.length(F.translate(t, "#*$%&|<>", "")), n - F.length(F.translate(t, "0123456789", ""))
    form = F.when(n == 0, "empty").when(100 * marks > 5 * n, "markup").when(100 * digits > 5 * n, "figures").otherwise("prose")
    return F.when(best > 0, F.element_at(F.array(*[F.lit(name) for name in topics]), F.array_position(hits, best).cast("int"))).otherwise(form)


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Per row: doc_id, source, lang, topic, tokens, draw, written; the texts are read once.

    Null sources and languages are values of their own, written as empty strings.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        topic(F.col(text_col)).alias("topic"),
        token_count(F.col(text_col)).alias("tokens"),
        draw(F.col(id_col)).alias("draw"),
    )
    return written(rows, "measured")


def marginal_targets(cells: DataFrame, dim: str, power: float, total: float) -> DataFrame:
    """(dim, target): tokens of each value of a marginal, in proportion to its token share to the given power; they sum to total."""
    tempered = cells.groupBy(dim).agg(F.pow(F.sum("tokens") / F.lit(total), F.lit(power)).alias("x"))
    all_of = tempered.agg(F.sum("x")).first()[0] or 1.0
    return tempered.select(dim, (F.lit(total) * F.col("x") / F.lit(float(all_of))).alias("target"))


def rake(cells: DataFrame, dims: Sequence[str], *, power: float, rounds: int = ROUNDS, residual: float = RESIDUAL) -> DataFrame:
    """cells (dims, tokens) with `weight`: tokens raked to marginal shares in proportion to share ^ power, total unchanged.

    A step sums the weighted cells by one marginal (partial sums first, so a value that most cells have is no hot spot) and
    scales them to its targets; cells are written once a round.  Ends after `rounds`, or when no weight moves any more.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    for d in dims:
        cells = cells.join(marginal_targets(cells, d, power, total).withColumnRenamed("target", f"t_{d}"), d)
    cells = written(cells.withColumn("weight", F.col("tokens").cast("double")), "raked-0")
    for n in range(rounds):
        after = cells.withColumn("before", F.col("weight"))
        for d in dims:
            after = after.join(after.groupBy(d).agg(F.sum("weight").alias("sum")), d).withColumn("weight", F.col("weight") * F.col(f"t_{d}") / F.col("sum")).drop("sum")
        after = written(after, f"raked-{n + 1}")
        moved = after.agg(F.max(F.abs(F.col("weight") / F.col("before") - 1))).first()[0] or 0.0
        drop_written(cells)
        cells = after.drop("before")
        if moved <= residual:
            break
    return cells.drop(*[f"t_{d}" for d in dims])


def calibrated(cells: DataFrame, share: float) -> float:
    """c such that min(1, c * rate) keeps this share of the tokens: cells that reach 1 are set aside until no more do."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    c = 0.0
    while True:
        full = F.lit(c) * F.col("weight") >= F.col("tokens")
        taken, rest = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        after = (share * total - float(taken or 0)) / rest if rest else c
        if after <= c * (1 + 1e-12):
            return max(after, c)
        c = after


def sampling_rates(rows: DataFrame, *, power: float, share: float, dims: Sequence[str] = DIMS) -> DataFrame:
    """(dims, rate, probability) of each cell of measured(), written; broadcast while they are few."""
    cells = written(rows.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    raked = written(rake(cells, dims, power=power), "raked")
    rate = F.col("weight") / F.col("tokens")
    rates = written(raked.select(*dims, rate.alias("rate"), F.least(F.lit(1.0), F.lit(calibrated(raked, share)) * rate).alias("probability")), "rates")
    drop_written(cells)
    drop_written(raked)
    return F.broadcast(rates) if rates.count() <= BROADCAST_CELLS else rates


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the md5 of the id as text; a null id counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", power: float = 0.9, share: float = KEPT_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, tokens, rate, probability, kept.

    share: the tokens that stay, in expectation.  Null and empty texts count one token and form the topic 'empty'; repeated
    rows share one draw; an empty table gives no row; other columns are not read.
    """
    rows = measured(docs, id_col=id_col, text_col=text_col, source_col=source_col, lang_col=lang_col)
    rates = sampling_rates(rows, power=power, share=share)
    return rows.join(rates, list(DIMS)).select("doc_id", "source", "lang", "topic", "tokens", "rate", "probability", (F.col("draw") < F.col("probability")).alias("kept"))


def copies(rate: Column, drawn: Column) -> Column:
    """How often a document is taken: the whole part of its rate, and once more if the draw is below the rest."""
    whole = F.floor(rate)
    return (whole + (drawn < rate - whole).cast("bigint")).cast("int")


def mixed_documents(docs: DataFrame, *, power: float = 0.9) -> DataFrame:
    """The rows of docs, each `rate` times in expectation, columns unchanged.

    The expected tokens are those of docs.  Rows that repeat an id share one draw; an empty table stays empty.  Texts are
    not shuffled unless there are more cells than may be broadcast.
    """
    rates = sampling_rates(measured(docs), power=power, share=KEPT_SHARE)
    keyed = docs.withColumns({"__source": F.coalesce(F.col("source").cast("string"), F.lit("")), "__lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "__topic": topic(F.col("text"))})
    rates = rates.select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.col("rate").alias("__rate"))
    return keyed.join(rates, ["__source", "__lang", "__topic"]).withColumn("__n", copies(F.col("__rate"), draw(F.col("doc_id")))).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def raking_sql(power: float = 0.9, share: float = KEPT_SHARE, rounds: int = ROUNDS, documents: str = "documents") -> str:
    """The same in SQL, as common table expressions; the last is `rated` with the columns of mix()."""
    hits = {name: " + ".join(f"contains(lower(t), '{w}')::INTEGER" for w in words) for name, words in TOPICS.items()}
    named = [f"WHEN h_{name} > 0 AND h_{name} = greatest({', '.join(f'h_{x}' for x in TOPICS)}) THEN '{name}'" for name in TOPICS]
    ctes = [
        f"""measured AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
      CASE {" ".join(named)} WHEN length(t) = 0 THEN 'empty'
           WHEN 100 * (length(t) - length(translate(t, '#*$%&|<>', ''))) > 5 * length(t) THEN 'markup'
           WHEN 100 * (length(t) - length(translate(t, '0123456789', ''))) > 5 * length(t) THEN 'figures' ELSE 'prose' END AS topic,
      len(list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) + 1 AS tokens,
      CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS draw
    FROM (SELECT *, {", ".join(f"{h} AS h_{n}" for n, h in hits.items())} FROM (SELECT *, coalesce(text, '') AS t FROM {documents})))""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM measured GROUP BY ALL)",
        "total AS (SELECT sum(tokens)::DOUBLE AS n FROM cells)",
    ]
    for d in DIMS:
        ctes.append(f"m_{d} AS (SELECT {d}, n * pow(sum(tokens) / n, {power}) / sum(pow(sum(tokens) / n, {power})) OVER () AS t_{d} FROM cells, total GROUP BY {d}, n)")
    ctes.append("w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS weight FROM cells JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic))")
    step = 0
    for _ in range(rounds):
        for d in DIMS:
            ctes.append(f"w{step + 1} AS MATERIALIZED (SELECT * REPLACE (weight * t_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight) FROM w{step})")
            step += 1
    ctes.append(f"sorted AS (SELECT sum(tokens) OVER o - tokens AS above, sum(weight) OVER (ORDER BY weight / tokens, source DESC, lang DESC, topic DESC) AS below FROM w{step} WINDOW o AS (ORDER BY weight / tokens DESC, source, lang, topic))")
    ctes.append(f"scale AS (SELECT max(({share} * n - above) / below) AS c FROM sorted, total)")
    ctes.append(f"rates AS (SELECT source, lang, topic, weight / tokens AS rate, least(1.0, c * weight / tokens) AS probability FROM w{step}, scale)")
    ctes.append("rated AS (SELECT doc_id, source, lang, topic, tokens, rate, probability, draw < probability AS kept FROM measured JOIN rates USING (source, lang, topic))")
    return "WITH " + ",\n".join(ctes)
