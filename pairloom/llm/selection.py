"""Which rows of a corpus stay, and how often: what the stages of a pipeline do with the operators' results.

Rows travel as one struct beside what decides about them, so columns of any name pass through, in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.jaccard_join import jaccard_components
from pairloom.llm.mixing import CLEAN, TARGETS, copies, rated, sparing, text_key
from pairloom.operators.sizing import small_side
from pairloom.workspace import cut_lineage


def whole_row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as the struct ``row``."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of linked texts one row: that with the smallest id, then the smallest hash of its text.

    Texts are linked, not ids, so one id may stand on rows with unlike texts. Rows without an id come last in their
    group. Texts without words link with nothing: of those only rows that repeat both id and text count once. What
    decides is a few numbers for each text; it is broadcast if small, else joined by shuffle.
    """
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    has_words = F.coalesce(text.rlike(r"[^ \t\n\x0B\f\r]"), F.lit(False))
    wordless = F.when(doc_id.isNotNull(), F.xxhash64(F.lit("wordless"), text, doc_id))
    name = F.when(has_words, F.xxhash64(text)).otherwise(wordless)
    rows = docs.select(whole_row(docs), doc_id.alias("id"), name.alias("name"))
    groups = jaccard_components(docs.filter(has_words).select(F.xxhash64(text).alias("doc_id"), text.alias("text")))
    linked = small_side(
        groups.filter("doc_id <> component_id")
        .select(F.col("doc_id").alias("name"), F.col("component_id").alias("grp"))
        .distinct()
    )
    by_name = (
        rows.filter("name is not null")
        .groupBy("name", "id")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("name")
        .agg(F.sum("n").alias("times"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("head"))
    )
    by_name = cut_lineage(by_name.join(linked, "name", "left").withColumn("grp", F.coalesce("grp", "name")))
    crowded = (
        by_name.groupBy("grp")
        .agg(F.sum("times").alias("all"), F.min(F.struct("head.none", "head.id", "name", "head.n")).alias("first"))
        .filter("all > 1")
    )
    verdicts = small_side(
        by_name.join(crowded, "grp").select(
            "name",
            (F.col("name") == F.col("first.name")).alias("stays"),
            F.col("first.id").alias("first_id"),
            F.col("first.n").alias("first_n"),
        )
    )
    kept = rows.join(verdicts, "name", "left").filter(
        F.col("stays").isNull() | (F.col("stays") & F.col("id").eqNullSafe(F.col("first_id")))
    )
    if not verdicts.filter("stays and first_n > 1").isEmpty():
        repeated = F.coalesce(F.col("first_n") > 1, F.lit(False))
        kept = kept.filter(~repeated).unionByName(kept.filter(repeated).dropDuplicates(["name"]))
    return kept.select("row.*")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, clean: str = CLEAN) -> DataFrame:
    """Every row as often as its rate says: none of the ``clean`` domain is left out, and none of another is
    repeated. Rows of one id and text get the same rate; rows without an id stay once."""
    rates = sparing(rated(docs, labels, targets), clean, [d for d in targets if d != clean])
    times = rates.groupBy("doc_id", "key").agg(F.max(copies(F.col("rate"))).alias("times"))
    times = times.select(F.col("doc_id").alias("rated_id"), F.col("key").alias("rated_key"), "times")
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("id"), text_key(F.col("text")).alias("text_key"))
    own = (F.col("id") == F.col("rated_id")) & (F.col("text_key") == F.col("rated_key"))
    often = F.array_repeat(F.lit(1), F.coalesce("times", F.lit(1)))
    return rows.join(times, own, "left").select("row", F.explode(often)).select("row.*")
