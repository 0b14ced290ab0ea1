"""Corpus tables derived from ``documents``: its languages become the sides of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.text import LINE_BREAKS
from pairloom.operators.align import zip_rows
from pairloom.operators.ordinal import dense_ordinal

# The languages of the table and their three-letter codes.
CODES = {"de": "deu", "en": "eng", "es": "spa", "fr": "fra"}
ANCHOR = "eng"
PAIRS = ["deu-eng", "eng-fra", "eng-spa"]
DIMENSION = ["deu_Latn", "eng_Latn", "fra_Latn", "spa_Latn", "zho_Hans", "zho_Hant"]
# A dimension in which Spanish is ambiguous and French is unknown.
UNEVEN_DIMENSION = ["deu_Latn", "eng_Latn", "spa_Latn", "spa_Hebr", "zho_Hans"]

SIDES = [
    ("source_text", "target_text"),
    ("source_lang", "target_lang"),
    ("source_id", "target_id"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(lang: Column) -> Column:
    code = F.when(F.lit(False), F.lit(None))
    for two, three in CODES.items():
        code = code.when(lang == two, three)
    return code


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their three-letter ``code`` and their position among those of the
    same language."""
    docs = table(spark, sf_dir, "documents").withColumn("code", code_of(F.col("lang")))
    return dense_ordinal(docs, ["lang"], "doc_id")


def one_line(text: str) -> Column:
    return F.regexp_replace(text, LINE_BREAKS, " ")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the i-th English document with the i-th one of every other language,
    turned round at odd positions. ``score`` compares the lengths."""
    docs = documents(spark, sf_dir)
    columns = ["ord", "doc_id", "code", "text", "n_chars"]

    def side(prefix: str, rows: DataFrame) -> DataFrame:
        return rows.select("ord", *(F.col(c).alias(prefix + c) for c in columns[1:]))

    english = side("e_", docs.filter("lang = 'en'"))
    others = side("o_", docs.filter("lang != 'en'"))
    both = zip_rows(english, others, ["ord"])
    even = F.col("ord") % 2 == 0

    def pick(a: str, b: str) -> Column:
        return F.when(even, F.col(a)).otherwise(F.col(b))

    low, high = F.least("e_n_chars", "o_n_chars"), F.greatest("e_n_chars", "o_n_chars")
    return both.select(
        F.concat_ws("-", F.least("e_code", "o_code"), F.greatest("e_code", "o_code")).alias(
            "lang_pair"
        ),
        "ord",
        pick("e_doc_id", "o_doc_id").alias("source_id"),
        pick("o_doc_id", "e_doc_id").alias("target_id"),
        pick("e_text", "o_text").alias("source_text"),
        pick("o_text", "e_text").alias("target_text"),
        pick("e_code", "o_code").alias("source_lang"),
        pick("o_code", "e_code").alias("target_lang"),
        (low.cast("double") / high).alias("score"),
    )


ID_COLUMNS = ["lang_pair", "ord", "source_id", "target_id", "source_lang", "target_lang"]
TEXTS = ["source_text", "target_text"]


def hashed(df: DataFrame, *columns: str) -> DataFrame:
    """Columns beside the MD5 of both texts."""
    return df.select(
        *columns, F.md5("source_text").alias("source_md5"), F.md5("target_text").alias("target_md5")
    )


def ids(df: DataFrame, *more: str) -> DataFrame:
    return hashed(df, *ID_COLUMNS, *more)


# The same tables in SQL. Numbered tables are materialised: DuckDB 2.0 mistakes
# ``row_number() - 1 < n`` for a filter on ``row_number()`` when it merges the two.

_CODE_SQL = "CASE lang " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in CODES.items()) + " END"

DOCUMENTS_SQL = f"""docs AS MATERIALIZED (
  SELECT *, {_CODE_SQL} AS code,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ord
  FROM documents)"""

PAIRS_SQL = (
    DOCUMENTS_SQL
    + """, pairs AS (
  SELECT least(e.code, o.code) || '-' || greatest(e.code, o.code) AS lang_pair, e.ord AS ord,
         CASE WHEN e.ord % 2 = 0 THEN e.doc_id ELSE o.doc_id END AS source_id,
         CASE WHEN e.ord % 2 = 0 THEN o.doc_id ELSE e.doc_id END AS target_id,
         CASE WHEN e.ord % 2 = 0 THEN e.text ELSE o.text END AS source_text,
         CASE WHEN e.ord % 2 = 0 THEN o.text ELSE e.text END AS target_text,
         CASE WHEN e.ord % 2 = 0 THEN e.code ELSE o.code END AS source_lang,
         CASE WHEN e.ord % 2 = 0 THEN o.code ELSE e.code END AS target_lang,
         least(e.n_chars, o.n_chars)::DOUBLE / greatest(e.n_chars, o.n_chars) AS score
  FROM docs e JOIN docs o ON e.ord = o.ord AND e.lang = 'en' AND o.lang <> 'en')"""
)

ORIENTED_SQL = (
    PAIRS_SQL
    + """, oriented AS (
  SELECT lang_pair, ord, score,
         CASE WHEN source_lang = 'eng' THEN source_id ELSE target_id END AS source_id,
         CASE WHEN source_lang = 'eng' THEN target_id ELSE source_id END AS target_id,
         CASE WHEN source_lang = 'eng' THEN source_text ELSE target_text END AS source_text,
         CASE WHEN source_lang = 'eng' THEN target_text ELSE source_text END AS target_text,
         CASE WHEN source_lang = 'eng' THEN source_lang ELSE target_lang END AS source_lang,
         CASE WHEN source_lang = 'eng' THEN target_lang ELSE source_lang END AS target_lang
  FROM pairs)"""
)


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    def cell(v) -> str:
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"
