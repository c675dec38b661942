"""Mixing sources to target weights by iterative proportional fitting.

Documents' tokens are summed by source, language and topic. The cells' weights are raked: in turn,
for each of the three, all cells of a value are scaled so that their weighted tokens meet the
value's target share. Documents are then kept with a probability in proportion to their cell's
weight, the largest weight being 1, by a hash of seed and doc_id: the kept tokens follow all three
marginals in expectation, and the same document is kept in every run. Where a token budget is given
it sets the scale instead: a document is then taken as often as its probability says (2.3: twice,
and a third time with chance 0.3), so a rare cell that is to weigh much does not thin out the others.

Targets are shares by value; where none are given they are the found shares to the power ``alpha``.
Only DataFrame functions are used. The raking works on cells, not on documents, and never leaves
the cluster.

Defined cases: a null or empty text has no tokens and weighs 1 token in no sum, but is sampled with
its cell's probability; a null source or language is a value of its own (NONE); rows with a null
doc_id are sampled by the hash of their text; repeated rows get the same decision; values without a
target keep nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized_join, staged

NONE = "(none)"
DIMENSIONS = ("source", "lang", "topic")
ALPHA = 0.85
ROUNDS = 10
TOPICS = 8
SEED = "mix-1"


def token_count(text: Column) -> Column:
    """Words between white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("bigint")


def topic_of(text: Column, topics: int = TOPICS) -> Column:
    """A topic by vocabulary: every different word of at least nine characters votes for one of
    the topics by its letters and length; the most voted one, the first of equals, 'none' without
    such words."""
    # the look-behind only spares tries within words
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![^ \t\n\r])[^ \t\n\r]{9,}"), F.lit(0)))
    votes = F.transform(words, lambda w: F.pmod(F.ascii(w) * 31 + F.char_length(w) * 7 + F.ascii(F.substring(w, 3, 1)), F.lit(topics)))

    def winner(votes: Column) -> Column:
        sizes = F.transform(F.sequence(F.lit(0), F.lit(topics - 1)), lambda t: F.struct(F.size(F.filter(votes, lambda v: v == t)).alias("n"), (-t).alias("t")))
        return F.aggregate(F.array(F.array_max(sizes)), F.lit(None).cast("string"), lambda _, m: F.when(m["n"] == 0, F.lit("none")).otherwise(F.concat(F.lit("topic"), (-m["t"]).cast("string"))))

    # a fold over one element binds the votes: named within the other functions they would be
    # counted again for every topic
    return F.aggregate(F.array(votes), F.lit(None).cast("string"), lambda _, v: winner(v))


def described(docs: DataFrame, topic: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """The rows with source, lang (NONE for null), topic and tokens; text '' for null. Columns
    named in ``keep`` come along as they are, as kept_<name>."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id"),
        text.alias("text"),
        F.coalesce(F.col("source").cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"),
        (topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(NONE))).alias("topic"),
        token_count(text).alias("tokens"),
        *[F.col(c).alias(f"kept_{c}") for c in keep or ()],
    )


def raked(cells: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """The cells (source, lang, topic, tokens) with column ``weight``.

    ``targets`` may hold, by dimension, tables of value and share; shares need not add up to 1.
    """
    whole = Window.partitionBy()
    for d in DIMENSIONS:
        if targets and d in targets:
            wanted = staged(targets[d].select(F.col("value").alias(d), F.col("share").cast("double").alias(f"want_{d}")), "targets")
        else:
            wanted = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(alpha)).alias(f"want_{d}"))
        wanted = staged(wanted.withColumn(f"want_{d}", F.col(f"want_{d}") / F.sum(f"want_{d}").over(whole)), "wanted")
        cells = sized_join(cells, wanted, [d], "left").withColumn(f"want_{d}", F.coalesce(f"want_{d}", F.lit(0.0)))
    now = staged(cells.withColumn("weight", F.lit(1.0)), "cells")
    total = float(now.agg(F.sum("tokens")).first()[0] or 0)
    for _ in range(rounds):
        for d in DIMENSIONS:
            have = F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(d))
            now = now.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"want_{d}") * F.lit(total) / have).otherwise(F.lit(0.0)))
    return now.select(*DIMENSIONS, "tokens", "weight")


def chance(seed: str, doc_id: Column, text: Column) -> Column:
    """A number from 0 to below 1 by the hash of seed and doc_id (of the text for a null doc_id)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.md5(text)))
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("bigint") / F.lit(float(1 << 48))


def probabilities(rows: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, budget: float | None = None) -> DataFrame:
    """Raked weight and sampling probability of every cell of described rows, staged. With a
    ``budget`` of tokens the probability is the expected number of copies and may exceed 1."""
    if budget is not None and budget <= 0:
        raise ValueError("a budget is a positive number of tokens")
    cells = staged(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    weights = staged(raked(cells, targets, alpha, rounds), "weights")
    unit = F.max("weight") if budget is None else F.sum(F.col("tokens") * F.col("weight")) / F.lit(float(budget))
    unit = weights.agg(unit).first()[0] or 1.0
    return weights.drop("tokens").withColumn("probability", F.col("weight") / F.lit(float(unit)))


def copies(probability: Column, chance: Column) -> Column:
    """How often a document is taken: its probability's whole part, and once more by the rest."""
    whole = F.floor(probability)
    return whole + (chance < probability - whole).cast("bigint")


def decisions(docs: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, seed: str = SEED, topic: Column | None = None, budget: float | None = None) -> DataFrame:
    """For every row: doc_id, source, lang, topic, tokens, weight, probability, copies, kept. Texts
    are read once; what they come down to is staged."""
    rows = described(docs, topic).withColumn("chance", chance(seed, F.col("doc_id"), F.col("text"))).drop("text")
    rows = staged(rows, "described")
    rows = sized_join(rows, probabilities(rows, targets, alpha, rounds, budget), list(DIMENSIONS))
    taken = copies(F.col("probability"), F.col("chance"))
    return rows.select("doc_id", *DIMENSIONS, "tokens", "weight", "probability", taken.alias("copies"), (taken > 0).alias("kept"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, alpha: float = ALPHA, rounds: int = ROUNDS, seed: str = SEED, topic: Column | None = None, keep: list[str] | None = None, budget: float | None = None) -> DataFrame:
    """As decisions, with the rows' text, and kept_<name> for the columns named in ``keep``. Texts
    are read twice, so that they need not be joined."""
    rows = described(docs, topic, keep)
    rows = sized_join(rows, probabilities(rows, targets, alpha, rounds, budget), list(DIMENSIONS))
    taken = copies(F.col("probability"), chance(seed, F.col("doc_id"), F.col("text")))
    rows = rows.withColumn("copies", taken).withColumn("kept", F.col("copies") > 0)
    return rows.select("doc_id", "text", *DIMENSIONS, "tokens", "weight", "probability", "copies", *[f"kept_{c}" for c in keep or ()], "kept")


def oracle_sql(alpha: float = ALPHA, rounds: int = ROUNDS, topics: int = TOPICS, seed: str = SEED) -> str:
    """The default mix as SQL on table documents, with the columns of the query."""
    wants = ", ".join(f"w_{d} AS (SELECT {d}, pow(sum(tokens)::DOUBLE, {alpha}) / sum(pow(sum(tokens)::DOUBLE, {alpha})) OVER () AS want_{d} FROM cells GROUP BY {d})" for d in DIMENSIONS)
    steps, last = [], "c0"
    for r in range(rounds):
        for d in DIMENSIONS:
            name = f"c{r}_{d}"
            have = f"sum(tokens * weight) OVER (PARTITION BY {d})"
            others = ", ".join(["source", "lang", "topic", "tokens", *[f"want_{x}" for x in DIMENSIONS]])
            steps.append(f"{name} AS MATERIALIZED (SELECT {others}, CASE WHEN {have} > 0 THEN weight * want_{d} * (SELECT sum(tokens)::DOUBLE FROM cells) / {have} ELSE 0 END AS weight FROM {last})")
            last = name
    return f"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS tokens,
         list_distinct(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]{{9,}}')) AS ws
  FROM documents),
votes AS (SELECT doc_id, text, source, lang, tokens, ws, list_transform(ws, lambda w: (ascii(w) * 31 + length(w) * 7 + ascii(w[3:3])) % {topics}) AS vs FROM words),
d AS (SELECT doc_id, text, source, lang, tokens,
         CASE WHEN len(ws) = 0 THEN 'none' ELSE 'topic' || (-(list_max(list_transform(range({topics}), lambda t: {{'n': len(list_filter(vs, lambda v: v = t)), 't': -t}}))).t)::VARCHAR END AS topic
  FROM votes),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
{wants},
c0 AS MATERIALIZED (SELECT cells.*, want_source, want_lang, want_topic, 1.0::DOUBLE AS weight FROM cells JOIN w_source USING (source) JOIN w_lang USING (lang) JOIN w_topic USING (topic)),
{", ".join(steps)},
p AS (SELECT source, lang, topic, weight, weight / max(weight) OVER () AS probability FROM {last})
SELECT doc_id, source, lang, topic, tokens, round(weight, 6) AS weight, round(probability, 6) AS probability,
       (('0x' || md5('{seed}:' || coalesce(doc_id::VARCHAR, md5(text)))[1:12])::BIGINT / 281474976710656.0) < probability AS kept
FROM d JOIN p USING (source, lang, topic)
"""
