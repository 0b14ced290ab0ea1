"""Streams of sentence pairs.

Orientation, recoding and language filters are the batch operators applied to a
streaming DataFrame: they are stateless, and the code dimension is a static side.
Positional joins, interleaving and shuffling need whole tables and stay batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from pairloom.commits import State, commit, files_read, read_state
from pairloom.operators.orient import orient, recode
from pairloom.operators.select import flat_to_pairs, select_pairs
from pairloom.operators.sizing import local_table, small_side
from pairloom.schema import FLAT, STORED_PAIR
from pairloom.sinks import write_pairs

#: Column that tells the file a row came from.
SOURCE_FILE = "source_file"


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType = STORED_PAIR,
    fmt: str = "parquet",
    max_files: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def read_flat_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return read_stream(spark, path, FLAT, fmt)


def stream_normalize(
    sdf: DataFrame, anchor: str, anchor_code: str, dim: DataFrame
) -> DataFrame:
    """Pairs oriented to ``anchor`` and recoded, as they arrive."""
    return recode(orient(sdf, anchor), anchor_code, dim)


def stream_flat(
    sdf: DataFrame, src: str, tgts: Sequence[str] | str | None = None
) -> DataFrame:
    """Rows of a flat corpus from ``src`` to the targets, as they arrive."""
    return flat_to_pairs(sdf, src, tgts)


def start_append(sdf: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table, then stop."""
    return (
        sdf.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def start_ingest(
    sdf: DataFrame,
    out: str,
    checkpoint: str,
    existing: DataFrame | None = None,
    source: str | None = None,
) -> StreamingQuery:
    """Store arriving pairs (with ``lang_pair`` and ``split``), then stop.

    The store is that of batch jobs. Every micro-batch is one commit, named by the
    stream's id (which its checkpoint keeps) and the batch's number, and tells the files it read; a repeated batch that was published
    is passed over, one that died before its commit is written anew. So a restart neither loses nor doubles rows, also when one
    pair's files arrive in several batches.

    Pairs named in ``existing`` are skipped. Without it, a split that the store has from other writers is theirs, and its
    rows are skipped, unless they come from the same ``source`` (by default the folder that a file lies in, without folders of
    partition values). A stream whose checkpoint is lost is another writer that reads the same source: it passes over the files that the
    log names and adds all others. ``source`` should be given where one stream reads several folders.

    The stream must read files, or have a column ``source_file``. See :func:`finish_ingest` for the end of a stream.
    """
    if SOURCE_FILE not in sdf.columns:
        try:
            sdf = sdf.withColumn(SOURCE_FILE, F.col("_metadata.file_path"))
        except AnalysisException as e:
            raise ValueError(f"the stream reads no files and has no column {SOURCE_FILE}") from e

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        if stream is None:
            raise RuntimeError("the stream has no id")
        name = f"{stream}-{batch_id}"
        state = read_state(spark, out) or State()
        if name in state.done:
            return
        place = F.regexp_replace(SOURCE_FILE, r"(/[^/=]+=[^/]*)*/[^/]*$", "") if source is None else F.lit(source)
        rows = batch.withColumn("_source", place)
        files = [r[0] for r in rows.select(SOURCE_FILE).distinct().collect()]  # those of one batch
        new = select_pairs(rows, existing=existing) if existing is not None else rows
        new = _unread(new, state, out, stream, files)
        if existing is None:
            new = _own(new, state, stream)
        came = new.groupBy("lang_pair", "split").agg(F.collect_set("_source").alias("s")).collect()
        write_pairs(
            new.select(*STORED_PAIR.names),
            out,
            ingest=name,
            writer=stream,
            complete=False,
            sources={(r.lang_pair, r.split): sorted(r.s) for r in came},
            files=files,
        )

    return (
        sdf.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _unread(rows: DataFrame, state: State, out: str, stream: str, files: list[str]) -> DataFrame:
    """Rows of files that no other stream has stored."""
    if not state.has_files - {stream}:
        return rows
    spark = rows.sparkSession
    mine = local_table(spark, [(f,) for f in files], StructType([StructField("file", StringType())]))
    read = files_read(spark, out, besides=stream).join(F.broadcast(mine), "file", "left_semi").collect()
    return rows.filter(~F.col(SOURCE_FILE).isin([r.file for r in read])) if read else rows


def _own(rows: DataFrame, state: State, stream: str) -> DataFrame:
    """Rows of splits that no other writer has, or has from the same source."""
    theirs: dict[tuple[str, str], set[str]] = {}
    for f in state.folders:
        if f.writer != stream:
            theirs.setdefault(f.key, set()).update(f.sources)
    own = {f.key for f in state.folders if f.writer == stream}
    taken = [(*key, sorted(sources)) for key, sources in sorted(theirs.items()) if key not in own]
    if not taken:
        return rows
    names = [StructField(n, StringType()) for n in ("_pair", "_split")]
    schema = StructType([*names, StructField("_sources", ArrayType(StringType()))])
    table = local_table(rows.sparkSession, taken, schema)
    met = rows.join(
        small_side(table), (F.col("lang_pair") == F.col("_pair")) & (F.col("split") == F.col("_split")), "left"
    )
    return met.filter(F.col("_pair").isNull() | F.array_contains("_sources", F.col("_source"))).drop(
        "_pair", "_split", "_sources"
    )


def finish_ingest(spark: SparkSession, out: str, query: StreamingQuery) -> None:
    """Wait for a stream that reads what is there, and say that the splits it wrote are whole, so that batch jobs do
    not read those pairs again."""
    query.awaitTermination()
    state = read_state(spark, out) or State()
    mine = {f.key for f in state.folders if f.writer == str(query.id) and not f.complete}
    if mine:
        commit(spark, out, f"{query.runId}-end", writer=str(query.id), completes=mine)
