"""Record types shared by sources, operators and sinks."""

from pyspark.sql.types import (
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _strings(*names: str) -> list[StructField]:
    return [StructField(n, StringType()) for n in names]


# Column names of the records that are read and written.
PAIR_COLUMNS = ["source_text", "target_text", "source_lang", "target_lang"]

#: The sentence pair.
PAIR = StructType(_strings(*PAIR_COLUMNS))

#: A stored sentence pair: partition keys, position in the pair, then the record.
STORED_PAIR = StructType(
    _strings("lang_pair", "split") + [StructField("ord", LongType())] + PAIR.fields
)

#: One aligned line file (or one shard of a side written as a folder).
CATALOG = StructType(
    _strings("lang_pair", "split", "side")
    + [StructField("is_gz", IntegerType())]
    + _strings("path", "shard")
    + [StructField("bytes", LongType())]
)

#: A corpus that keeps both language codes per row and has no pair folders.
FLAT = StructType(_strings("src_text", "tgt_text", "src_lang", "tgt_lang"))

CACHE = StructType(
    [StructField("ord", LongType())] + _strings("source_text", "translation")
)

#: The cache as it is stored: bucket and two halves of the text's key, then the row.
STORED_CACHE = StructType(
    [StructField("bucket", IntegerType())]
    + [StructField(n, LongType()) for n in ("k1", "k2")]
    + CACHE.fields
)

#: Script-qualified codes such as ``ces_Latn``; ``ord`` is the position in the list.
CODES = StructType(_strings("script_code") + [StructField("ord", LongType())])

ISO = StructType(_strings("alpha_3", "alpha_2"))
