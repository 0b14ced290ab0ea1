"""The commit log: readers see whole commits only, and a restart neither loses nor doubles rows."""

import os
import threading

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairloom import commits, sinks
from pairloom.commits import Conflict, Folder, commit, files_read, read_state, vacuum
from pairloom.plans import corpus
from pairloom.schema import STORED_PAIR
from pairloom.sinks import adopt, write_pairs
from pairloom.sources.tables import complete_pairs, read_pairs, stored_pairs, stored_splits
from pairloom.streaming import pairs as streams


def table(spark, pair, places, mark="s", split="train"):
    left, right = pair.split("-")
    data = [(pair, split, i, f"{pair} {mark}{i}", f"t{i}", left, right) for i in places]
    return spark.createDataFrame(data, STORED_PAIR)


def texts(spark, out, split="train"):
    return [t for (t,) in rows(read_pairs(spark, out, split=split), "source_text")]


def dies(*args, **kwargs):
    raise RuntimeError("killed")


def folder(pair, name):
    return Folder(pair, "train", name, name, 1, True)


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "store")
    write_pairs(table(spark, "a-b", range(3)), out)
    old = texts(spark, out)
    for mode in ("append", "override", "overwrite"):
        with monkeypatch.context() as m:
            m.setattr(sinks, "commit", dies)
            with pytest.raises(RuntimeError, match="killed"):
                write_pairs(table(spark, "a-b", range(2), "new"), out, mode)
        assert texts(spark, out) == old
    write_pairs(table(spark, "a-b", range(2), "new"), out, "override")
    assert texts(spark, out) == ["a-b new0", "a-b new1"]
    # four folders do not count: three of jobs that died, one that was replaced
    assert len(vacuum(spark, out)) == 4 and vacuum(spark, out) == []
    assert texts(spark, out) == ["a-b new0", "a-b new1"]


def test_a_reader_that_is_under_way_keeps_its_rows(spark, tmp_path):
    out = str(tmp_path / "store")
    write_pairs(table(spark, "a-b", range(3)), out)
    before = read_pairs(spark, out)
    write_pairs(table(spark, "a-b", range(1), "new"), out, "overwrite")
    assert before.count() == 3 and read_pairs(spark, out).count() == 1


def test_override_replaces_its_splits_only(spark, tmp_path):
    out = str(tmp_path / "store")
    write_pairs(table(spark, "a-b", range(2)).union(table(spark, "a-b", range(2), split="val")), out)
    write_pairs(table(spark, "c-d", range(1)), out)
    write_pairs(table(spark, "a-b", range(1), "new"), out, "override")
    assert texts(spark, out) == ["a-b new0", "c-d s0"] and len(texts(spark, out, "val")) == 2
    assert rows(stored_splits(spark, out)) == [("a-b", "train"), ("a-b", "val"), ("c-d", "train")]
    with pytest.raises(ValueError, match="unknown mode"):
        write_pairs(table(spark, "a-b", range(1)), out, "replace")


def test_an_ingest_that_is_published_is_not_written_again(spark, tmp_path):
    out = str(tmp_path / "store")
    for _ in range(2):
        write_pairs(table(spark, "a-b", range(2)), out, ingest="once")
    assert texts(spark, out) == ["a-b s0", "a-b s1"] and read_state(spark, out).version == 1
    write_pairs(table(spark, "a-b", ()), out, ingest="nothing")
    assert "nothing" in read_state(spark, out).done


def test_writers_that_meet_take_one_version_each(spark, tmp_path):
    out, errors = str(tmp_path / "store"), []

    def write(name):
        try:
            for i in range(5):
                commit(spark, out, f"{name}{i}", [folder("a-b", f"{name}{i}")])
        except Exception as e:  # shown by the assertion below
            errors.append(e)

    threads = [threading.Thread(target=write, args=(n,)) for n in "xyz"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    state = read_state(spark, out)
    assert errors == [] and state.version == 15 and len(state.folders) == 15
    assert commit(spark, out, "x0", [folder("a-b", "x0")]) == 15


def test_a_commit_can_be_refused(spark, tmp_path):
    out = str(tmp_path / "store")
    commit(spark, out, "first", [folder("a-b", "first")])
    with pytest.raises(Conflict, match="taken"):
        commit(spark, out, "late", [folder("a-b", "late")], unless=lambda s: "taken" if s.folders else None)
    assert [f.ingest for f in read_state(spark, out).folders] == ["first"]


def test_snapshots_hold_what_the_log_says(spark, tmp_path, monkeypatch):
    plain, short = str(tmp_path / "plain"), str(tmp_path / "short")
    for out, every in ((plain, 1000), (short, 3)):
        monkeypatch.setattr(commits, "SNAPSHOT", every)
        for i in range(8):
            gone = [("p0-x", "train")] if i == 5 else []
            commit(spark, out, f"c{i}", [folder(f"p{i % 3}-x", f"c{i}")], replaces=gone, files=[f"f{i}"] * (i % 2))
        commit(spark, out, "end", completes=[("p1-x", "train")])
    assert any(n.endswith(".snapshot.json") for n in os.listdir(f"{short}/_log"))
    assert read_state(spark, plain) == read_state(spark, short)
    assert rows(files_read(spark, short)) == [(f"f{i}",) for i in (1, 3, 5, 7)]
    assert rows(files_read(spark, short, besides="c3")) == [(f"f{i}",) for i in (1, 5, 7)]


def test_a_store_without_a_log_is_adopted(spark, tmp_path):
    out = str(tmp_path / "store")
    assert read_state(spark, out) is None
    old = table(spark, "a-b", range(2)).withColumn("ingest", F.lit("batch"))
    old.write.partitionBy("lang_pair", "split", "ingest").parquet(out)
    assert rows(stored_pairs(spark, out)) == [("a-b",)] and len(texts(spark, out)) == 2
    with pytest.raises(ValueError, match="adopt"):
        write_pairs(table(spark, "c-d", range(1)), out)
    adopt(spark, out)
    write_pairs(table(spark, "c-d", range(1)), out)
    assert texts(spark, out) == ["a-b s0", "a-b s1", "c-d s0"]
    with pytest.raises(Conflict, match="has a log"):
        commit(spark, out, "again", unless=lambda state: "the store has a log" if state.version else None)


# Streams -------------------------------------------------------------------------------


def start(spark, src, out, checkpoint, **more):
    return streams.start_ingest(streams.read_stream(spark, src, max_files=1), out, checkpoint, **more)


def land(spark, path, *more, **marks):
    table(spark, *more, **marks).coalesce(1).write.mode("append").parquet(path)


def stops_after(monkeypatch, n):
    """The stream dies when it is about to write its batch ``n``."""
    write = streams.write_pairs

    def limited(df, out, **more):
        if int(more["ingest"].rsplit("-", 1)[1]) >= n:
            dies()
        write(df, out, **more)

    monkeypatch.setattr(streams, "write_pairs", limited)


def test_a_pair_that_was_half_stored_is_completed(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, "a-b", range(10))
    land(spark, src, "a-b", range(10, 20))
    with monkeypatch.context() as m:
        stops_after(m, 1)
        with pytest.raises(Exception, match="killed"):
            start(spark, src, out, str(tmp_path / "lost")).awaitTermination()
    assert len(texts(spark, out)) == 10
    start(spark, src, out, str(tmp_path / "new")).awaitTermination()
    assert len(texts(spark, out)) == len(set(texts(spark, out))) == 20


def test_a_batch_that_comes_again_doubles_nothing(spark, tmp_path, monkeypatch):
    src, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    land(spark, src, "a-b", range(10))
    land(spark, src, "a-b", range(10, 20))
    write = streams.write_pairs

    def dies_behind(df, out, **more):
        write(df, out, **more)
        if more["ingest"].endswith("-1"):
            dies()  # published, but the stream does not know

    with monkeypatch.context() as m:
        m.setattr(streams, "write_pairs", dies_behind)
        with pytest.raises(Exception, match="killed"):
            start(spark, src, out, checkpoint).awaitTermination()
    start(spark, src, out, checkpoint).awaitTermination()
    assert len(texts(spark, out)) == len(set(texts(spark, out))) == 20


def test_other_sources_leave_what_is_stored(spark, tmp_path):
    out = str(tmp_path / "out")
    for name, places in (("one", range(3)), ("two", range(5))):
        land(spark, str(tmp_path / name), "a-b", places)
        start(spark, str(tmp_path / name), out, str(tmp_path / f"cp-{name}")).awaitTermination()
    assert len(texts(spark, out)) == 3
    # folders of one named source belong together
    for day in ("1", "2"):
        land(spark, str(tmp_path / "days" / day), "c-d", [int(day)])
        more = {"source": "days"}
        start(spark, str(tmp_path / "days" / day), out, str(tmp_path / f"cp-{day}"), **more).awaitTermination()
    assert texts(spark, out)[3:] == ["c-d s1", "c-d s2"]


def test_a_stream_must_tell_its_files(spark, tmp_path):
    rates = spark.readStream.format("rate").load()
    with pytest.raises(ValueError, match="source_file"):
        streams.start_ingest(rates, str(tmp_path / "out"), str(tmp_path / "cp"))


def put(root, name, lines):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.writelines(f"{x}\n" for x in lines)


def test_batch_jobs_read_again_what_a_stream_left_in_part(spark, tmp_path, monkeypatch):
    src, out, root = (str(tmp_path / x) for x in ("in", "out", "root"))
    for side in ("src", "trg"):
        put(root, f"a-b/train.{side}", [f"a-b s{i}" for i in range(20)])
    land(spark, src, "a-b", range(10))
    land(spark, src, "a-b", range(10, 20))
    with monkeypatch.context() as m:
        stops_after(m, 1)
        with pytest.raises(Exception, match="killed"):
            start(spark, src, out, str(tmp_path / "cp")).awaitTermination()
    assert rows(complete_pairs(spark, out)) == [] and rows(stored_pairs(spark, out)) == [("a-b",)]
    corpus.ingest(spark, root, out)
    assert len(texts(spark, out)) == len(set(texts(spark, out))) == 20
    assert rows(complete_pairs(spark, out)) == [("a-b",)]
    # the stream goes on, but the pair is whole now
    start(spark, src, out, str(tmp_path / "cp")).awaitTermination()
    assert len(texts(spark, out)) == 20


def test_a_stream_that_has_ended_is_whole(spark, tmp_path):
    src, out, root = (str(tmp_path / x) for x in ("in", "out", "root"))
    for side in ("src", "trg"):
        put(root, f"a-b/train.{side}", ["other"])
    land(spark, src, "a-b", range(2))
    streams.finish_ingest(spark, out, start(spark, src, out, str(tmp_path / "cp")))
    assert rows(complete_pairs(spark, out)) == [("a-b",)]
    counts = rows(corpus.ingest(spark, root, out))
    assert counts == [(1, 1, 0)] and texts(spark, out) == ["a-b s0", "a-b s1"]


def test_two_batch_runs_do_not_both_add_a_pair(spark, tmp_path, monkeypatch):
    out, root = str(tmp_path / "out"), str(tmp_path / "root")
    for side in ("src", "trg"):
        put(root, f"a-b/train.{side}", ["one", "two"])
    read = corpus.read_aligned

    def slow(*args):
        monkeypatch.setattr(corpus, "read_aligned", read)
        corpus.ingest(spark, root, out)  # another run is faster
        return read(*args)

    monkeypatch.setattr(corpus, "read_aligned", slow)
    with pytest.raises(Conflict, match="a-b"):
        corpus.ingest(spark, root, out)
    assert texts(spark, out) == ["one", "two"]
