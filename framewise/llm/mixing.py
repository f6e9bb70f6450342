"""Mixing sources to target weights by iterative proportional fitting (raking), in DataFrame operations only.

Documents are reduced to cells (source, lang, topic) with their tokens (words split at white space). Each round scales
the cells' weights to the target share of every source, then language, then topic, with a sum over a window per
category; the cells, not the documents, go round. Rounds are written to the shared folder every ``cut_every`` rounds,
which bounds the plan and survives lost executors. The number of rounds is fixed and the same at every size. A
document's probability is ``least(1, rate * fitted / tokens)`` of its cell, where rate brings the expected tokens to ``keep`` of all
tokens before clipping at 1, and it is drawn by an md5 of its id: reproducible, independent of partitions.

Targets: a marginal is a dict of category to weight (those not listed share the weight of ``OTHER``, nothing by
default, by their tokens), or a number a: proportional to tokens ** a of each category (0: equal, 1: as they are).

Defined cases: null text has no tokens and weight 0, and is kept only if its probability, that of its cell, says so;
null source or language is the category ``unknown``; empty tables give empty tables; repeated rows are drawn alike
(same id, same draw); documents with clashing extra columns keep them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, table, uniform, unlike

ROUNDS, CUT_EVERY, KEEP = 10, 5, 0.5
OTHER = "other"
#: Default marginals: sources and topics tempered, languages by these weights.
SOURCE_POWER, TOPIC_POWER = 0.5, 0.5
LANGS = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
#: Weight of all languages beyond these, ``unknown`` included, if there are any.
OTHER_LANGS = 0.1
DIGITS = 9


def n_tokens(text: Column) -> Column:
    """Runs of other characters between spaces, tabs and line ends."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\r]+", -1)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic of a text by its form: listing, shouting, numeric or prose, from simple counts of signs."""
    t = F.coalesce(text, F.lit(""))
    n, size = F.length(t), F.octet_length(t)
    bars = size - F.octet_length(F.replace(t, F.lit("|"), F.lit("")))
    digits = size - F.octet_length(F.regexp_replace(t, "[0-9]+", ""))
    shouts = size - F.octet_length(F.replace(t, F.lit("!"), F.lit("")))
    return F.when(bars * 50 > n, "listing").when(shouts * 50 > n, "shouting").when(digits * 50 > n, "numeric").otherwise("prose")


def _target(cells: DataFrame, key: str, marginal: float | dict[str, float], total: float) -> Column:
    """The target tokens of a cell's category, as a column over cells."""
    own = F.sum("tokens").over(Window.partitionBy(key))
    if isinstance(marginal, dict):
        named = F.coalesce(*[F.when(F.col(key) == k, F.lit(float(v))) for k, v in sorted(marginal.items()) if k != OTHER], F.lit(None).cast("double"))
        rest = float(marginal.get(OTHER, 0.0))
        if rest:
            rest /= cells.where(named.isNull()).agg(F.sum("tokens")).first()[0] or 1.0
        return F.coalesce(named, F.lit(rest) * own)
    return F.pow(own.cast("double"), F.lit(float(marginal)))


def _fill(part: Window, to: Column, cap: Column, w: Column) -> tuple[Column, Column]:
    """cap / w, and the candidates of the factor f for which the sum of least(cap, f * w) over a window's partition is ``to``: the greatest that isn't above its cap / w."""
    r = F.when(w > 0, cap / w)
    before, after = part.orderBy(r.asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1), part.orderBy(r.asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    return r, (to - F.coalesce(F.sum(F.when(w > 0, cap)).over(before), F.lit(0.0))) / F.nullif(F.sum(w).over(after), F.lit(0.0))


def _bounded(cells: DataFrame, keys: list[str], total: float, rounds: int, cut_every: int, keep: float) -> DataFrame:
    """Raked weights of which none asks for more than all of a cell's tokens: a category with too few tokens for its target gives all of
    them and the others share the rest, and within a category what full cells can't give comes from the others."""
    cells = cells.withColumns({"_u": F.col("w"), "_cap": F.col("tokens") / F.lit(float(keep) * float(total or 1))})
    for key in keys:
        c = durable(cells.where("tokens > 0").groupBy(key).agg(F.first(f"_to_{key}").alias("t"), F.sum("_cap").alias("cap")))
        r, f = _fill(Window.partitionBy(F.lit(1)), F.lit(1.0), F.col("cap"), F.col("t"))
        x = c.withColumn("r", r).withColumn("f", f).agg(F.coalesce(F.max(F.when(F.col("f") <= F.col("r"), F.col("f"))), F.max("r"))).first()[0]
        own = F.sum("_cap").over(Window.partitionBy(key))
        cells = cells.withColumn(f"_to_{key}", F.least(own, F.lit(float(x or 0.0)) * F.col(f"_to_{key}")))
    cells = durable(cells)
    for i in range(rounds):
        for key in keys:
            p = Window.partitionBy(key)
            r, f = _fill(p, F.col(f"_to_{key}"), F.col("_cap"), F.col("_u"))
            cells = cells.withColumn("_r", r).withColumn("_f", f)
            x = F.coalesce(F.max(F.when(F.col("_f") <= F.col("_r"), F.col("_f"))).over(p), F.max("_r").over(p), F.lit(0.0))
            cells = cells.withColumn("_u", F.col("_u") * x)
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            cells = durable(cells)
    return cells.withColumn("w", F.least("_u", "_cap"))


def calibrate(cells: DataFrame, marginals: dict[str, float | dict[str, float]], rounds: int = ROUNDS, cut_every: int = CUT_EVERY, keep: float = KEEP, bounded: bool = False) -> DataFrame:
    """cells (source, lang, topic, tokens) with fitted share and probability. With ``bounded`` no probability has to be cut at 1."""
    cells = durable(cells)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    keys = list(marginals)
    for key, m in marginals.items():
        cells = cells.withColumn(f"_raw_{key}", _target(cells, key, m, total))
    for key in keys:  # a category's weight becomes its share of all categories present that have tokens
        one = cells.where("tokens > 0").groupBy(key).agg(F.first(f"_raw_{key}").alias("v")).agg(F.sum("v")).first()[0] or 1.0
        cells = cells.withColumn(f"_to_{key}", F.col(f"_raw_{key}") / F.lit(one)).drop(f"_raw_{key}")
    cells = durable(cells.withColumn("w", F.col("tokens").cast("double") / F.lit(float(total or 1))))
    if bounded:
        cells, rounds = _bounded(cells, keys, total, rounds, cut_every, keep), 0
    for i in range(rounds):
        for key in keys:
            s = F.sum("w").over(Window.partitionBy(key))
            cells = cells.withColumn("w", F.when(s > 0, F.col("w") * F.col(f"_to_{key}") / s).otherwise(F.lit(0.0)))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            cells = durable(cells)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(float(keep) * float(total)) * F.col("w") / F.col("tokens"))).otherwise(F.lit(0.0))
    return durable(cells.select(*keys, "tokens", F.round("w", DIGITS).alias("share"), F.round(p, DIGITS).alias("probability")))


CELL = ("source", "lang", "topic", "tokens")


def with_cells(docs: DataFrame, names: list[str] | tuple[str, ...] = ("_source", "_lang", "_topic", "_tokens")) -> DataFrame:
    """docs with the cell of each document and its tokens, in columns of the four names."""
    source, lang, kind, tokens = names
    return docs.withColumns({source: F.coalesce("source", F.lit("unknown")), lang: F.coalesce("lang", F.lit("unknown")), kind: topic(F.col("text")), tokens: n_tokens(F.col("text"))})


def _weighed(d: DataFrame, names: list[str], marginals: dict | None, rounds: int, keep: float, bounded: bool) -> DataFrame:
    """d, which has its cells in the first four of names, with share, probability and sampled in the others."""
    marginals = marginals or {"source": SOURCE_POWER, "lang": {**LANGS, OTHER: OTHER_LANGS}, "topic": TOPIC_POWER}
    own, (share, probability, sampled) = dict(zip(CELL, names)), names[4:]
    cells = d.groupBy(*[F.col(own[k]).alias(k) for k in marginals]).agg(F.sum(own["tokens"]).alias("tokens"))
    fitted = calibrate(cells, marginals, rounds, keep=keep, bounded=bounded)
    fitted = fitted.select(*[F.col(k).alias(own[k]) for k in marginals], F.col("share").alias(share), F.col("probability").alias(probability))
    out = d.join(fitted, [own[k] for k in marginals], "left")  # AQE splits a hot cell, or broadcasts cells of a small size
    return out.withColumn(sampled, uniform(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mix") < F.col(probability))


ADDED = (*CELL, "share", "probability", "sampled")


def weigh(docs: DataFrame, marginals: dict | None = None, rounds: int = ROUNDS, keep: float = KEEP, bounded: bool = False) -> DataFrame:
    """docs with their cell and _share, _probability and _sampled (behind more underscores where docs have such columns)."""
    names = unlike(docs.columns, *ADDED)
    return _weighed(with_cells(docs, names[:4]), names, marginals, rounds, keep, bounded)


def sample(docs: DataFrame, marginals: dict | None = None, rounds: int = ROUNDS, keep: float = KEEP) -> DataFrame:
    """The documents drawn, with their own columns."""
    return weigh(docs, marginals, rounds, keep, bounded=True).where(F.col(unlike(docs.columns, *ADDED)[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    names = [f"_{c}" for c in ADDED]
    docs = with_cells(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), names[:4])
    narrow = durable(docs.select("doc_id", *names[:4]))  # texts are parsed once; cells and probabilities come from these numbers
    w = _weighed(narrow, names, None, ROUNDS, KEEP, False)
    return w.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.round("_probability", 6).alias("probability"), F.col("_sampled").alias("sampled"))


def sql(rounds: int = ROUNDS, keep: float = KEEP) -> str:
    """The same in DuckDB SQL."""
    t = "coalesce(text, '')"
    out = [
        f"""WITH d AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  CASE WHEN (length({t}) - length(replace({t}, '|', ''))) * 50 > length({t}) THEN 'listing' WHEN (length({t}) - length(replace({t}, '!', ''))) * 50 > length({t}) THEN 'shouting'
       WHEN (length({t}) - length(translate({t}, '0123456789', ''))) * 50 > length({t}) THEN 'numeric' ELSE 'prose' END AS topic,
  CAST(len(regexp_extract_all({t}, '[^ \\t\\n\\r]+')) AS BIGINT) AS n_tokens FROM documents),
c0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
c1 AS (SELECT *, pow(sum(tokens) OVER (PARTITION BY source), {SOURCE_POWER}) AS rs, CASE lang {' '.join(f"WHEN '{k}' THEN {float(v)}" for k, v in sorted(LANGS.items()))} ELSE 0.0 END AS rl, pow(sum(tokens) OVER (PARTITION BY topic), {TOPIC_POWER}) AS rt FROM c0),
w0 AS (SELECT source, lang, topic, tokens, rs / (SELECT sum(v) FROM (SELECT source, max(rs) AS v FROM c1 WHERE tokens > 0 GROUP BY 1)) AS ts, rl / (SELECT sum(v) FROM (SELECT lang, max(rl) AS v FROM c1 WHERE tokens > 0 GROUP BY 1)) AS tl,
  rt / (SELECT sum(v) FROM (SELECT topic, max(rt) AS v FROM c1 WHERE tokens > 0 GROUP BY 1)) AS tt, tokens / sum(tokens) OVER () AS w FROM c1)"""
    ]
    last = 0
    for _ in range(rounds):
        for key, to in (("source", "ts"), ("lang", "tl"), ("topic", "tt")):
            last += 1
            out.append(f"w{last} AS MATERIALIZED (SELECT source, lang, topic, tokens, ts, tl, tt, CASE WHEN sum(w) OVER (PARTITION BY {key}) > 0 THEN w * {to} / sum(w) OVER (PARTITION BY {key}) ELSE 0.0 END AS w FROM w{last - 1})")
    out.append(f"f AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN round(least(1.0, {float(keep)} * sum(tokens) OVER () * w / tokens), {DIGITS}) ELSE 0.0 END AS p FROM w{last})")
    return ",\n".join(out) + "\nSELECT doc_id, source, lang, topic, n_tokens, round(p, 6) AS probability, CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) / 4503599627370496.0 < p AS sampled FROM d JOIN f USING (source, lang, topic)"
