"""URL filters: rules by host and path, and a logistic regression where no rule fits.

Features are hashed character n-grams of host and path, each kind apart; the regression is trained
by full-batch gradient descent, each feature scaled by its curvature, on a small labelled table of URLs (``url_labels`` unless another is given), kept in the
checkpoint folder. All
of it is column functions and aggregates; what the driver sees is one number for each of
``BUCKETS`` features.

Defined results: a null URL or one without ``://`` has empty host and path, fits no rule and has no
n-grams, so the model's intercept decides; without labelled URLs of both verdicts everything
undecided is allowed. Repeated rows each give a row. Columns beyond the id and the URL are ignored.
Empty in, empty out.
"""

from __future__ import annotations

import math
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.url_labels import url_labels
from pairloom.workspace import cut_lineage

#: Hashed features; lengths of n-grams.
BUCKETS = 4096
GRAMS = (3, 4, 5)

#: Labelled URLs of each verdict that are trained on, those with the smallest hashes.
SAMPLE_URLS = 2000

#: Gradient steps and their length beside the curvature of each feature, what is added to that, and the ridge that keeps
#: weights small.
STEPS = 20
RATE = 0.1
DAMPING = 1e-4
RIDGE = 1e-4


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path:
    what follows that up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    rest = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1)
    host = F.translate(F.substring_index(rest, "/", 1), _UPPER, _LOWER)
    return host, rest


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with the columns ``host`` and ``path``."""
    host, rest = host_and_path(F.col("_url"))
    return (
        df.withColumn("_url", F.col(url).cast("string"))
        .withColumn("host", host)
        .withColumn("_rest", rest)
        .withColumn("path", F.expr("substring(_rest, length(host) + 1)"))
        .drop("_url", "_rest")
    )


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits ``host`` and ``path``, or null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # later ones, longer, go outermost
        fits = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
        fits = fits & F.col("path").startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams(buckets: int = BUCKETS) -> Column:
    """Hashed n-grams of ``host`` and ``path``; both are framed, so their ends are features too."""
    parts = []
    for mark, column in (("h", "host"), ("p", "path")):
        framed = F.concat(F.lit("^"), F.col(column), F.lit("$"))
        for n in GRAMS:
            hashed = F.transform(
                # cut into characters once: a place within a string is found by walking from its start
                F.array(F.split(framed, "")),
                lambda chars: F.transform(
                    F.sequence(F.lit(0), F.size(chars) - n),
                    lambda i: F.pmod(
                        F.xxhash64(F.lit(mark), F.concat(*(F.get(chars, i + k) for k in range(n)))), F.lit(buckets)
                    ).cast("int"),
                ),
            )[0]
            some = (F.length(framed) >= n) & (F.length(column) > 0)
            parts.append(F.when(some, hashed).otherwise(F.array().cast("array<int>")))
    return F.concat(*parts)


class Model(NamedTuple):
    weights: list[float]
    intercept: float


def margin(model: Model, features: str = "grams") -> Column:
    """The log-odds of ``block``: the mean weight of the n-grams, times the root of their number."""
    table = F.split(F.lit(",".join(f"{w:.9g}" for w in model.weights)), ",").cast("array<double>")
    total = F.aggregate(features, F.lit(0.0), lambda a, g: a + F.get(table, g))
    return F.lit(model.intercept) + total * _scale(features)


def _scale(features: str) -> Column:
    return F.when(F.size(features) > 0, 1 / F.sqrt(F.size(features))).otherwise(F.lit(0.0))


def train(
    labelled: DataFrame,
    url: str = "url",
    label: str = "verdict",
    buckets: int = BUCKETS,
    sample: int = SAMPLE_URLS,
    steps: int = STEPS,
) -> Model | None:
    """A model of ``label`` (block or allow); None unless both occur."""
    usable = (
        labelled.select(F.col(url).cast("string").alias("url"), (F.col(label) == "block").cast("double").alias("label"))
        .filter("url is not null and label is not null")
        .distinct()
    )
    # each task keeps its own smallest hashes, so no task sees a whole verdict
    rows = reduce(
        DataFrame.union,
        (usable.filter(F.col("label") == v).orderBy(F.xxhash64("url"), "url").limit(sample) for v in (0.0, 1.0)),
    )
    rows = with_parts(rows.select("url", "label")).select("label", grams(buckets).alias("grams"))
    rows = cut_lineage(rows)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked")).first()
    if not size.n or not 0 < size.blocked < size.n:
        return None
    intercept = math.log(size.blocked / (size.n - size.blocked))
    model = Model([0.0] * buckets, intercept)
    bends = rows.select(F.explode("grams").alias("g"), (_scale("grams") * _scale("grams")).alias("part"))
    curvature = [DAMPING] * buckets
    for r in bends.groupBy("g").agg(F.sum("part").alias("part")).collect():  # a row for each feature
        curvature[r.g] += 0.25 * r.part / size.n
    for _ in range(steps):
        off = rows.select(
            "grams", (1 / (1 + F.exp(-margin(model))) - F.col("label")).alias("off"), _scale("grams").alias("scale")
        )
        gradient = [RIDGE * w for w in model.weights]
        parts = off.select(F.explode("grams").alias("g"), (F.col("off") * F.col("scale")).alias("part"))
        for r in parts.groupBy("g").agg(F.sum("part").alias("part")).collect():  # a row for each feature
            gradient[r.g] += r.part / size.n
        model = Model([w - RATE * g / c for w, g, c in zip(model.weights, gradient, curvature)], intercept)
    return model


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, p_block`` of every row. Trains on ``labelled`` (``url,
    verdict``), by default the table of ``url_labels``."""
    name, verdict = rule_columns(rules)
    parts = with_parts(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url")))
    ruled = parts.withColumn("rule", name).withColumn("_ruled", verdict)
    model = train(url_labels(pages.sparkSession) if labelled is None else labelled)
    if model is None:
        chance = F.lit(0.0)
    else:
        chance = 1 / (1 + F.exp(-margin(model)))
    judged = ruled.withColumn("grams", grams()).withColumn("p_block", chance)
    by_model = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("_ruled", by_model).alias("verdict"), "p_block")
