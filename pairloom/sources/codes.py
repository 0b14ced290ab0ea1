"""Language-code dimensions.

The lists themselves are data: they are passed in, read from a file, or derived from
the corpora that define them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pairloom.functions.text import base_code, left_code, right_code, strip_text
from pairloom.operators.sizing import local_table
from pairloom.schema import CODES, ISO


def code_dimension(spark: SparkSession, codes: Sequence[str]) -> DataFrame:
    """``script_code, ord`` from a list of script-qualified codes."""
    return local_table(spark, [(c, i) for i, c in enumerate(codes)], CODES)


def code_requests(spark: SparkSession, codes: Sequence[str] | str) -> DataFrame:
    """``code``: the base codes of a request, a list or a comma-separated text."""
    listed = codes.split(",") if isinstance(codes, str) else list(codes)
    schema = StructType([StructField("code", StringType())])
    return local_table(spark, [(c.strip(),) for c in listed], schema).select(
        base_code("code").alias("code")
    )


def read_codes(spark: SparkSession, path: str) -> list[str]:
    """A code list from a text file, one code per line; blank lines are skipped.

    Code lists have some hundreds of entries and live on the driver from here on.
    """
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\r\n|\r|\n")))
    return [r[0] for r in lines.select(strip_text("col")).collect() if r[0]]


def codes_of_wide_table(wide: DataFrame) -> list[str]:
    """The script codes a wide evaluation table covers: its ``sentence_<code>`` columns."""
    mark = "sentence_"
    return [c.removeprefix(mark) for c in wide.columns if c.startswith(mark)]


def codes_of_catalog(catalog: DataFrame) -> DataFrame:
    """``code``: every code that occurs in a pair name of the catalog."""
    return catalog.select(
        F.explode(F.array(left_code("lang_pair"), right_code("lang_pair"))).alias("code")
    ).distinct()


def iso_dimension(spark: SparkSession, rows: Sequence[tuple[str, str | None]]) -> DataFrame:
    """``alpha_3, alpha_2`` for ``to_iso639_1``."""
    return local_table(spark, list(rows), ISO)


def vocabulary(spark: SparkSession, langs: Sequence[str]) -> DataFrame:
    schema = StructType([StructField("lang", StringType())])
    return local_table(spark, [(l,) for l in langs], schema)
