from conftest import rows

from pairloom.operators.orient import orient, recode
from pairloom.schema import STORED_PAIR
from pairloom.sinks import write_pairs
from pairloom.sources.codes import code_dimension
from pairloom.sources.tables import read_pairs
from pairloom.streaming import pairs as streams


def stored(spark, out, *pairs):
    data = [
        (p, "train", i, f"{p} s{i}", f"{p} t{i}", p.split("-")[0], p.split("-")[1])
        for p in pairs for i in range(3)
    ]
    df = spark.createDataFrame(data, STORED_PAIR)
    write_pairs(df, out)
    return df


def test_stream_equals_batch(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = stored(spark, src, "ces-eng", "eng-fra", "ces-zho")
    dim = code_dimension(spark, ["ces_Latn", "eng_Latn", "zho_Hans", "zho_Hant"])
    normal = streams.stream_normalize(streams.read_stream(spark, src, max_files=1), "ces", "ces_Latn", dim)
    streams.start_append(normal, f"{out}/rows", f"{out}/cp").awaitTermination()
    expected = rows(recode(orient(df, "ces"), "ces_Latn", dim), *STORED_PAIR.names)
    assert rows(spark.read.parquet(f"{out}/rows"), *STORED_PAIR.names) == expected
    assert len(expected) == 3


def test_ingest_adds_what_arrives(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    existing = spark.createDataFrame([("ces-eng",)], "lang_pair string")
    stored(spark, src, "ces-eng", "ces-fra")

    def run():
        stream = streams.read_stream(spark, src, max_files=1)
        streams.start_ingest(stream, f"{out}/rows", f"{out}/cp", existing).awaitTermination()
        return sorted(r.lang_pair for r in read_pairs(spark, f"{out}/rows").collect())

    assert run() == ["ces-fra"] * 3
    assert run() == ["ces-fra"] * 3
    # more of a pair that this stream has stored before is not lost
    stored(spark, src, "ces-fra", "deu-fra")
    assert run() == ["ces-fra"] * 6 + ["deu-fra"] * 3
