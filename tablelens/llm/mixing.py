"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic) with their tokens.
The cells' token weights are raked: scaled to the target share of each source,
then of each language, then of each topic, again and again until all three
marginals fit.  Weights start at the token budget's share of what is there and
never exceed what is there (bounded raking).  A document of a cell is then
kept with probability weight / tokens: the expected tokens of the sample meet
the targets.  A hash of the id takes the decision, so it is reproducible.

A label of which there is less than its target wants gives all it has, and the
rest goes to the other labels in proportion to their targets.  Targets of
different keys may still be at odds (all of a label lies in sources that are to
shrink).  What the raked weights miss of the given targets is returned with
every document as the gaps of its labels, and by ``balance`` per label.

Only DataFrame operations are used.  The table of cells has at most one row
per combination of labels, however many documents there are; it is written
every few cycles, and its largest change, one number, ends the loop.

A null label is a label of its own.  A null text has no tokens; cells without
tokens have probability 1, as they change no marginal.  Targets default to the
observed shares to the power of ``temperature``, normalised.  Rows with the
same id (null: the text) share one fate.  An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

BUDGET = 0.5
TEMPERATURE = 0.7
CYCLES, TOLERANCE = 40, 1e-7
# Cells that one task rakes, and cycles of theirs between two tables.
CELLS_AT_A_TIME = 100_000
AT_ONCE = 8

# Topics by the first pattern that occurs, for tables without a topic column.
TOPICS = (
    ("licence", r"(?i)licen[sc]ed|all rights reserved|public domain"),
    ("code", r"[A-Za-z_] ?= ?\"|[{};] *(\n|$)|\(\) *\{"),
    ("contact", r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]"),
    ("listing", r" \| "),
)
OTHER = "prose"


def topic_of(text: Column) -> Column:
    out = F.lit(OTHER)
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def tokens_of(text: Column) -> Column:
    """Words between ASCII spaces: the places where a word begins."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _targets(cells: DataFrame, key: str, temperature: float, given: DataFrame | None) -> DataFrame:
    """(key, size, share): tokens and target share of each label; labels without a given target get 0."""
    seen = cells.groupBy(key).agg(F.sum("tokens").alias("size"))
    if given is None:
        share = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(temperature))).otherwise(0.0)
        seen = seen.select(key, "size", share.alias("share"))
    else:
        given = given.select(F.col(given.columns[0]).alias("label"), F.col(given.columns[1]).cast("double").alias("share"))
        seen = seen.join(given, F.col(key).eqNullSafe(F.col("label")), "left").select(
            key, "size", F.when(F.col("size") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("share")
        )
    return seen.withColumn("share", F.coalesce(F.try_divide("share", F.sum("share").over(Window.partitionBy())), F.lit(0.0)))


def _within_reach(targets: DataFrame, key: str, wanted: Column) -> DataFrame:
    """``targets`` with ``aim``: tokens of each label, all that it has or its share times one factor for all, ``wanted`` in total.

    In the order of tokens per share, the factor for the labels from one on, if
    those before give all they have, rises and then falls; its peak is the one.
    """
    order = Window.orderBy(F.col("size") / F.col("share"))
    live = targets.where("share > 0")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
    peak = live.withColumn("factor", (wanted - before) / after).withColumn("factor", F.max("factor").over(Window.partitionBy()))
    aims = peak.select(F.col(key).alias("label"), F.least(F.col("size").cast("double"), F.col("share") * F.col("factor")).alias("aim"))
    found = targets.join(aims, F.col(key).eqNullSafe(F.col("label")), "left")
    return found.select(key, F.col("share").alias(f"target_{key}"), F.coalesce("aim", F.lit(0.0)).alias(f"aim_{key}"))


KEYS = ("source", "lang", "topic")


def _cycle(cells: DataFrame, in_one: bool) -> DataFrame:
    """One round of scaling to each marginal, with the bound of what is there.

    Sums per label are windows where one task holds all cells, and grouped sums joined back where not.
    """
    for key in KEYS:
        if in_one:
            cells = cells.withColumn("held", F.sum("weight").over(Window.partitionBy(key)))
        else:
            sums = cells.groupBy(F.col(key).alias("label")).agg(F.sum("weight").alias("held"))
            cells = cells.join(sums, F.col(key).eqNullSafe(F.col("label"))).drop("label")
        scaled = F.col("weight") * F.col(f"aim_{key}") / F.col("held")
        cells = cells.withColumn("weight", F.when(F.col("held") > 0, scaled).otherwise(0.0)).drop("held")
    return cells.withColumn("weight", F.least("weight", F.col("tokens").cast("double")))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET,
    temperature: float = TEMPERATURE, cycles: int = CYCLES, tolerance: float = TOLERANCE, cut_budget: bool = False,
) -> DataFrame:
    """Cells (source, lang, topic, tokens) with ``weight``, the tokens to sample, ``probability``, and per key the target and the gap.

    ``gap_<key>``: the share that the label gets less the one that it should have.
    With ``cut_budget`` the budget falls to where every label has what its target wants.
    """
    cells = materialize(cells, "cells")
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    parts = max(1, math.ceil(n / CELLS_AT_A_TIME))
    together = lambda df: df.coalesce(parts)
    wanted = float(total or 0) * budget
    aims = {key: materialize(_targets(together(cells), key, temperature, (targets or {}).get(key)), f"targets-{key}") for key in KEYS}
    for key in KEYS:  # no key's labels can give more
        most = F.min(F.col("size") / F.col("share")) if cut_budget else F.sum("size")
        wanted = min(wanted, float(aims[key].where("share > 0").agg(most).first()[0] or 0))
    start = together(cells).withColumn("weight", F.col("tokens") * F.lit(budget))
    for key in KEYS:
        aim = _within_reach(together(aims[key]), key, F.lit(wanted)).withColumnRenamed(key, "label")
        start = start.join(together(aim), F.col(key).eqNullSafe(F.col("label"))).drop("label")
    now = materialize(together(start), "raked")
    at_once = AT_ONCE if parts == 1 else 1
    for done in range(0, cycles, at_once):
        after = together(now)
        for _ in range(min(at_once, cycles - done)):
            after = after.withColumn("old", F.col("weight"))
            after = _cycle(after, parts == 1)
        now = materialize(after, "raked")
        moved = now.agg(F.max(F.abs(F.col("weight") - F.col("old")) / F.greatest("old", F.lit(1.0)))).first()[0]
        if moved is None or moved < tolerance:
            break
    probability = F.when(F.col("tokens") > 0, F.least(F.col("weight") / F.col("tokens"), F.lit(1.0))).otherwise(1.0)
    for key in KEYS:
        held = now.groupBy(F.col(key).alias("label")).agg(F.sum("weight").alias("held"))
        share = F.coalesce(F.try_divide("held", F.sum("held").over(Window.partitionBy())), F.lit(0.0))
        held = together(held).withColumn("share", share).drop("held")  # one row per label
        now = now.join(held, F.col(key).eqNullSafe(F.col("label"))).withColumn(f"gap_{key}", F.col("share") - F.col(f"target_{key}")).drop("label", "share")
    return materialize(
        together(now).select(*KEYS, "tokens", "weight", probability.alias("probability"), *[f"{x}_{key}" for x in ("target", "gap") for key in KEYS]), "raked"
    )


def balance(raked: DataFrame) -> DataFrame:
    """(key, label, tokens, weight, target, share, gap) of each label of raked cells."""
    out = None
    for key in KEYS:
        part = raked.groupBy(F.lit(key).alias("key"), F.col(key).alias("label")).agg(
            F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight"), F.max(f"target_{key}").alias("target"), F.max(f"gap_{key}").alias("gap")
        )
        part = part.select("key", "label", "tokens", "weight", "target", (F.col("target") + F.col("gap")).alias("share"), "gap")
        out = part if out is None else out.unionByName(part)
    return out


def draw(name: Column) -> Column:
    """A number in [0, 1) that depends on the id alone: the first 13 hexadecimal digits of its MD5."""
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _counted(
    docs: DataFrame, into: str, id_col: str, text_col: str, topic_col: str | None
) -> DataFrame:
    """``docs`` with ``into``: struct of topic, n_tokens and the number drawn."""
    text = F.col(f"`{text_col}`")
    topic = F.col(f"`{topic_col}`") if topic_col else topic_of(F.coalesce(text, F.lit("")))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), text, F.lit(""))
    return docs.withColumn(into, F.struct(topic.alias("topic"), tokens_of(text).alias("n_tokens"), draw(name).alias("drawn")))


def _mixed(
    counted: DataFrame, into: str, source_col: str, lang_col: str, targets: dict[str, DataFrame] | None, budget: float, temperature: float
) -> DataFrame:
    """``counted`` with ``into``: struct of topic, n_tokens, probability, sampled and the gaps of the labels."""
    m = F.col(into)
    cells = counted.groupBy(F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"), m["topic"].alias("topic"))
    raked = rake(cells.agg(F.sum(m["n_tokens"]).alias("tokens")), targets, budget, temperature)
    r = {c: fresh(counted, f"cell_{c}") for c in raked.columns}
    joined = counted.join(
        raked.withColumnsRenamed(r),
        F.col(f"`{source_col}`").eqNullSafe(F.col(r["source"]))
        & F.col(f"`{lang_col}`").eqNullSafe(F.col(r["lang"]))
        & m["topic"].eqNullSafe(F.col(r["topic"])),
    )
    p = F.col(r["probability"])
    gaps = [F.col(r[f"gap_{key}"]).alias(f"gap_{key}") for key in KEYS]
    result = F.struct(m["topic"].alias("topic"), m["n_tokens"].alias("n_tokens"), p.alias("probability"), (m["drawn"] < p).alias("sampled"), *gaps)
    return joined.withColumn(into, result).select(*[F.col(f"`{c}`") for c in counted.columns])


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, temperature: float = TEMPERATURE,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, into: str = "mix",
) -> DataFrame:
    """``docs`` with ``into``: struct of topic, n_tokens, probability, sampled and the gaps of the labels."""
    return _mixed(_counted(docs, into, id_col, text_col, topic_col), into, source_col, lang_col, targets, budget, temperature)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its cell, tokens, probability and its labels' gaps (6 places), and whether it is sampled.

    Texts are read once: what is counted of them is written without them.
    """
    counted = _counted(docs.select("doc_id", "text", "source", "lang"), "mix", "doc_id", "text", None).drop("text")
    m = F.col("mix")
    return _mixed(materialize(counted, "counted"), "mix", "source", "lang", None, BUDGET, TEMPERATURE).select(
        "doc_id", "source", "lang", m["topic"].alias("topic"), m["n_tokens"].alias("n_tokens"),
        F.round(m["probability"], 6).alias("probability"), m["sampled"].alias("sampled"),
        *[F.round(m[f"gap_{key}"], 6).alias(f"gap_{key}") for key in KEYS],
    )


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents."""
    name = fresh(docs, "mix")
    return mix(docs, into=name, **options).where(F.col(name)["sampled"]).select(*[F.col(f"`{c}`") for c in docs.columns])
