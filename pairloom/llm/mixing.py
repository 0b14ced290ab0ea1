"""Mixing documents to target weights by soft membership.

A classifier learned from a labelled table gives each document a posterior over domains. Every
document then gets a nonnegative rate (how often it is to be seen), such that the expected
tokens of each domain, counting each document by its posterior, meet the targets. The rates solve a
least-squares problem by projected gradient steps from rate 1: a step lowers the rates of
documents in domains that are over target, raises those of others, and cuts at 0. A step needs a few
sums over all documents, so the gradient is distributed and the driver sees numbers for domains and pairs of domains only.

The classifier is naive Bayes on the presence of the words that tell the classes of a bounded sample
of labelled documents apart, and on how far the lines of a text repeat. All is columns, joins and
aggregates.

Texts, not ids, are classified: equal texts share a posterior. Defined results: a null text counts as
an empty one, with 0 tokens; without usable labelled rows of two domains all documents are in all
domains alike, and rates are 1 if no text has tokens. A domain without any document keeps its
excess; the others are met. Repeated rows each give a row. Columns beyond those named are ignored.
Empty in, empty out.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.workspace import cut_lineage

#: Target share of the tokens of each domain; the domains of the query are classes of ``labels``.
TARGETS = {"good": 0.90, "poor": 0.08, "toxic": 0.02}
#: The domain of which a mix loses nothing; the others are not repeated.
CLEAN = "good"

#: Labelled documents of each domain that are learned from, those with the smallest hashes.
SAMPLE_DOCS = 1500

#: Words the classifier knows: for each domain, those that tell most.
WORDS_EACH = 300

#: Gradient steps, at most, and the relative excess at which they end.
STEPS = 12
CLOSE = 1e-3

#: Added to the diagonal of the curvature, as a part of it.
RIDGE = 1e-3

#: Documents of one domain that a known word is in, at least.
LEAST_SEEN = 10

#: A word tells a domain if it is e to this power more frequent in it than in any other.
TELLS = 1.0


class Model(NamedTuple):
    """``words``: ``word`` and its log-odds in each domain; ``start``: log-prior of each domain, with what the
    absence of all words says."""

    words: DataFrame
    start: dict[str, float]


def label_domain() -> Column:
    """The domain of a row of ``labels``."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")


def words(text: Column) -> Column:
    """Words of a text as they stand, with capitals and punctuation; empty ones where spaces repeat."""
    for white in "\n\t\r":
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.split(text, " ")


def form(text: Column) -> Column:
    """A word that tells how far the lines of a text repeat."""
    lines = F.split(text, "\n")
    fresh = F.size(F.array_distinct(lines)) / F.size(lines)
    repeated = F.when(fresh < 0.5, 2).when(fresh < 0.8, 1).otherwise(0)
    return F.array(F.concat(F.lit(" repeated="), repeated.cast("string")))


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and a key that equal texts share."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn(
        "key", text_key(F.col("text"))
    )


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE_DOCS) -> Model | None:
    """At most ``WORDS_EACH`` words for each domain, and the forms. ``labelled`` has ``doc_id, domain``. None if fewer
    than two domains have rows.

    Labels are drawn from those whose documents are there and have text, and the sizes of the domains count the rows read.
    """
    usable = (
        labelled.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), "domain")
        .distinct()
    )
    readable = _keyed(docs).filter("text <> ''")
    # ids only, read once for all domains; the sample is small
    there = cut_lineage(
        readable.select("doc_id")
        .groupBy("doc_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(usable, "doc_id")
        .select("doc_id", "domain", "rows")
    )
    # each task keeps its own smallest hashes, so no task sees a whole domain
    by_hash = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = cut_lineage(
        reduce(DataFrame.union, (there.filter(F.col("domain") == d).orderBy(*by_hash).limit(sample) for d in domains))
    )
    sizes = {r.domain: r["rows"] for r in chosen.groupBy("domain").agg(F.sum("rows").alias("rows")).collect()}
    if len(sizes) < 2:
        return None
    text = F.col("text")
    seen = (
        readable.join(F.broadcast(chosen.select("doc_id", "domain")), "doc_id")
        .select("domain", F.explode(F.array_distinct(F.concat(words(text), form(text)))).alias("word"))
        .groupBy("domain", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    by_word = seen.filter("word <> ''").groupBy("word").agg(
        *(F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(d) for d in domains)
    )
    rate = {d: (F.col(d) + 0.5) / (sizes.get(d, 0) + 1.0) for d in domains}
    # read by every domain below
    by_word = cut_lineage(by_word.filter(F.greatest(*(F.col(d) for d in domains)) >= LEAST_SEEN))
    weights = by_word.select(
        "word",
        *(F.log(rate[d] / (1 - rate[d])).alias(f"w_{d}") for d in domains),
        *(F.log(1 - rate[d]).alias(f"a_{d}") for d in domains),
        *(F.col(d).alias(f"n_{d}") for d in domains),
    )
    table = weights.filter(F.col("word").startswith(" "))
    for d in domains:
        others = [F.col(f"w_{x}") for x in domains if x != d]
        beyond = F.col(f"w_{d}") - (F.greatest(*others) if len(others) > 1 else others[0])
        tells = F.col(f"n_{d}") * beyond
        table = table.union(weights.filter(beyond > TELLS).orderBy(F.desc(tells), "word").limit(WORDS_EACH))
    table = cut_lineage(table.distinct())
    # a word that is missing speaks too: what all missing together say is added once
    absent = table.agg(*(F.sum(f"a_{d}").alias(d) for d in domains)).first()
    start = {d: math.log((sizes.get(d, 0) + 0.5) / (sum(sizes.values()) + 1)) + (absent[d] or 0.0) for d in domains}
    return Model(table.select("word", *(f"w_{d}" for d in domains)), start)


def posteriors(docs: DataFrame, model: Model | None, domains: list[str]) -> DataFrame:
    """``doc_id, key, tokens`` and ``p_<domain>`` for every row.

    Words meet the bounded table of the model by broadcast where they are read; what is shuffled is one
    row for each text and known word in it, folded before it travels, so copies of a text count once.
    """
    keyed = _keyed(docs)
    text = F.col("text")
    rows = keyed.select("doc_id", "key", F.size(F.array_remove(words(text), "")).cast("long").alias("tokens"))
    if model is None:
        even = [F.lit(1 / len(domains)).alias(f"p_{d}") for d in domains]
        return rows.select("doc_id", "key", "tokens", *even)
    weights = [f"w_{d}" for d in domains]
    hits = (
        keyed.select("key", F.explode(F.concat(form(text), words(text))).alias("word"))
        .join(F.broadcast(model.words), "word")
        .groupBy("key", "word", *weights)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    scores = hits.groupBy("key").agg(*(F.sum(w).alias(w) for w in weights))
    soft = {d: F.coalesce(f"w_{d}", F.lit(0.0)) + F.lit(model.start[d]) for d in domains}
    top = F.greatest(*soft.values())
    mass = {d: F.exp(soft[d] - top) for d in domains}
    total = sum(mass.values())
    shares = [(mass[d] / total).alias(f"p_{d}") for d in domains]
    return rows.join(scores, "key", "left").select("doc_id", "key", "tokens", *shares)


def fit_rates(members: DataFrame, targets: Mapping[str, float], tokens: float | None = None, steps: int = STEPS) -> DataFrame:
    """``members`` (``tokens``, ``p_<domain>``) with ``rate``.

    ``targets`` are shares of ``tokens``, by default as many as there are. Each step is a projected gradient step,
    scaled by the curvature of the rows whose rate is not at 0: one pass sums what is reached and, for each two
    domains, the tokens they share, which is a small matrix. Without the scaling domains that are rare would need many
    steps. Where targets contradict each other the ridge keeps steps finite, and the closest rates are kept.
    """
    domains = list(targets)
    members = cut_lineage(members)
    rate: Column = F.lit(1.0)
    best: tuple[float, Column] | None = None
    want: dict[str, float] = {}
    for _ in range(steps + 1):
        rated = members.withColumn("rate", rate)
        heavy = F.col("tokens") * (F.col("rate") > 0).cast("double")
        totals = rated.agg(
            *(F.sum(F.col("tokens") * F.col(f"p_{d}") * F.col("rate")).alias(d) for d in domains),
            *(
                F.sum(heavy * F.col(f"p_{d}") * F.col(f"p_{e}")).alias(f"{d} {e}")
                for i, d in enumerate(domains)
                for e in domains[i:]
            ),
            F.sum("tokens").alias("all tokens"),
        ).first()
        budget = (totals["all tokens"] or 0) if tokens is None else tokens
        if not budget:
            break
        whole = sum(targets.values())
        want = {d: budget * targets[d] / whole for d in domains}
        off = np.array([(totals[d] or 0.0) - want[d] for d in domains])
        error = float(np.abs(off).max()) / budget
        if best is None or error < best[0]:
            best = error, rate
        if error <= CLOSE:
            break
        shared = np.array([[totals[" ".join(sorted((d, e), key=domains.index))] or 0.0 for e in domains] for d in domains])
        present = np.flatnonzero(np.diag(shared) > 0)
        if not len(present):
            break
        part = shared[np.ix_(present, present)]
        step = np.linalg.solve(part + RIDGE * np.diag(np.diag(part)), off[present])
        change = sum(F.col(f"p_{domains[i]}") * F.lit(float(x)) for i, x in zip(present, step))
        rate = F.greatest(F.lit(0.0), rate - change)
    return members.withColumn("rate", best[1] if best else F.lit(1.0))


def text_key(text: Column) -> Column:
    """The key that rows of :func:`rated` have from their text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def rated(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """``doc_id, key, tokens, p_<domain> ..., rate`` of every row of ``docs``."""
    domains = list(targets)
    labelled = labels.select("doc_id", label_domain().alias("domain"))
    model = learn(docs, labelled, domains)
    return fit_rates(posteriors(docs, model, domains), targets)


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS) -> DataFrame:
    """``doc_id, tokens, p_<domain> ..., rate`` of every row of ``docs``."""
    return rated(docs, labels, targets).drop("key")


def sparing(members: DataFrame, clean: str, others: list[str]) -> DataFrame:
    """``members`` with rates that drop no document of ``clean`` and repeat none of ``others``.

    Where the targets ask for fewer ``clean`` tokens than there are, all rates rise by one factor, so that those tokens
    are met in full and the others keep their ratio to them. Then a document that is in ``clean`` as much as in any
    other domain has a rate of 1 at least, and any other document of 1 at most.
    """
    mine = F.col(f"p_{clean}")
    weight = F.col("tokens") * mine
    reached = members.agg(F.try_divide(F.sum(weight * F.col("rate")), F.sum(weight)).alias("r")).first().r
    raised = F.col("rate") * (max(1.0, 1 / reached) if reached else 1.0)
    is_clean = mine >= F.greatest(F.lit(0.0), *(F.col(f"p_{d}") for d in others))
    return members.withColumn("rate", F.when(is_clean, F.greatest(raised, F.lit(1.0))).otherwise(F.least(raised, F.lit(1.0))))


def copies(rate: Column, seed: int = 0) -> Column:
    """How often a row is to be seen: the whole part of its rate, and once more by a draw from the
    row's id."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    return F.floor(rate + draw).cast("int")
