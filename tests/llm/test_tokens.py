"""Sequence files, whitening and importance resampling: brute force, the library itself, awkward rows, empty tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import rows
from tokenizers import Tokenizer

from llm_data import AWKWARD, awkward, empty, prose  # noqa: F401
from pairloom.llm import importance, sequences, whitening

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

# Sequence files ------------------------------------------------------------------------

STRANGE = [
    "It's 20231 o'clock, isn't it?!  ''s 's x's!'S ÉCOLE «été», été Å Å K Ω",
    "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>",
    "≠ ≮ 1́ a,̈b don't'll ’s 日本語テキスト。漢字abc123漢字,  x y z\x85w",
    "ΑΣ Σ ΣΑΣ. İstanbul ß ﬁ ²³ ½ Ⅷ ①",
    "\x00\x01 tab\there\r\nnew\x0bline\x0cpage \x1c\x1d end",
    "e" * 3000 + " " + "=" * 3000 + " " + "7" * 500,
    "🙂🙂🏽 👩‍👩‍👧 a🙂b",
    "a_b-c/d\\e[f]{g}|h~i`j@k#l$m%n^o&p*q(r)s+t=u:v;w\"x'y<z>",
]


def test_units_encode_as_whole_texts_do():
    encoder = sequences.UnitEncoder(VOCABULARY)
    library = Tokenizer.from_file(VOCABULARY)
    texts = [*STRANGE, *(t for _, t, *_ in AWKWARD), prose(4, 500).title()]
    for some in (texts, texts[:1], texts[2:], [None, "", " "]):
        got = []
        for first, ids, n in encoder.texts(pa.array(some, pa.string()), end=1):
            got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [library.encode(t or "", add_special_tokens=False).ids + [1] for t in some]


def test_a_vocabulary_that_mixes_units_is_refused():
    with pytest.raises(ValueError, match="apart"):
        sequences.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_known_units_are_forgotten_by_age():
    known = sequences._Known(2)
    for u in "abc":
        known.put(u, u.encode())
    assert [known.get(u) for u in "abc"] == [b"a", b"b", b"c"]
    known.put("d", b"d")
    known.put("e", b"e")
    known.put("x" * 100, b"x")
    assert len(known._new) <= 2 and len(known._old) <= 2 and known.get("x" * 100) is None


def _expected(docs):
    library, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("length, batch, file_bytes", [(8, 4, 1000), (1024, 256, 10**9), (100, 1, 3000)])
def test_documents_come_back_from_their_files(spark, tmp_path, length, batch, file_bytes):
    docs = [(i, t) for i, t in enumerate(STRANGE * 6)] + [(100, None), (101, ""), (102, prose(9, 4000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = str(tmp_path / "out")
    sequences.write_sequences(df, out, VOCABULARY, length, batch, file_bytes=file_bytes)
    assert rows(sequences.read_documents(spark, out)) == sorted(_expected(docs), key=repr)
    library = Tokenizer.from_file(VOCABULARY)
    back = {r.doc_id: r.ids for r in sequences.read_documents(spark, out, ids=True).collect()}
    assert all(back[d] == library.encode(t or "", add_special_tokens=False).ids + [1] for d, t in docs)

    files = sequences.read_manifest(spark, out).orderBy("part").collect()
    every = [i for d, t in docs for i in library.encode(t or "", add_special_tokens=False).ids + [1]]
    found = []
    for f in files:
        mapped = sequences.SequenceFile(f.path)
        assert len(mapped) == f.n_sequences and f.offset == len(found)
        for ids, mask in map(mapped.__getitem__, range(len(mapped))):
            assert len(ids) == len(mask) == length and not ids.flags.owndata and not mask.flags.owndata
            found += ids[mask == 1].tolist()
        assert all(mapped[i][1].all() for i in range(len(mapped) - 1))
        with pytest.raises(IndexError):
            mapped[len(mapped)]
        # the plain format: anyone's reader opens it
        table = pa.ipc.open_stream(pa.memory_map(f.path)).read_all()
        kind = table.schema.field("input_ids").type
        assert kind.list_size == length and kind.value_type == pa.uint16()
    assert found == every
    assert sequences.read_sequences(spark, out).count() == sum(f.n_sequences for f in files)


def test_sequences_of_awkward_rows(spark, awkward, empty):
    got = rows(sequences.token_digests(awkward, VOCABULARY), "doc_id", "n_tokens", "ids_crc32")
    want = [(d, n, c) for d, _, n, c in _expected([(d, t) for d, t, *_ in AWKWARD])]
    assert got == sorted(want, key=repr)
    placed = sorted((r.start, r.n_tokens, r.doc_id) for r in sequences.token_digests(awkward, VOCABULARY).collect())
    assert placed[0][0] == 0 and placed[0][2] is None  # rows without an id come first
    assert all(a[0] + a[1] == b[0] and (a[2] or 0) <= b[2] for a, b in zip(placed, placed[1:]))
    assert sequences.token_digests(empty, VOCABULARY).collect() == []


def test_a_file_in_no_manifest_is_not_read(spark, tmp_path):
    df = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    out = str(tmp_path / "out")
    sequences.write_sequences(df, out, VOCABULARY)
    before = rows(sequences.read_documents(spark, out))
    (tmp_path / "out" / "files" / "part-00000000-lost.arrow").write_bytes(b"half a file")
    assert rows(sequences.read_documents(spark, out)) == before


# Whitening -----------------------------------------------------------------------------


def _dense(vectors):
    x = np.unique(np.floor(256 * np.array(vectors, float)).astype(np.int64), axis=0)
    c = x - x.mean(axis=0)
    values, units = np.linalg.eigh(c.T @ c / len(x))
    return x, values[::-1], units[:, ::-1]


@pytest.mark.parametrize("n, d, seed", [(300, 8, 0), (500, 40, 1), (200, 3, 2), (400, 90, 3)])
def test_whitening_equals_dense_eigenvectors(spark, n, d, seed):
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((n, d)) * np.linspace(2, 0.5, d)).astype(np.float32).tolist()
    data = [(i, v) for i, v in enumerate(vectors)] + [(n, vectors[0]), (n, vectors[0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    x, values, units = _dense(vectors)
    out = whitening.whiten(df).collect()
    assert len(out) == (n + 2) * min(4, d)
    sums = x.sum(axis=0)
    for r in out:
        own = np.floor(256 * np.array(vectors[r.vec_id % n], float)).astype(np.int64)
        j = r.component - 1
        assert r.n == len(x) and r.deviation == int(((len(x) * own - sums) ** 2).sum())
        want = (own - x.mean(axis=0)) @ units[:, j] / math.sqrt(values[j])
        assert abs(abs(r.whitened) - abs(want)) < 1e-8
        assert abs(r.explained / (values[j] / values.sum()) - 1) < 1e-10
        assert r.identity_error < 1e-10
    # one sign for all rows of a component
    for j in range(1, min(4, d) + 1):
        mine = {r.vec_id: r.whitened for r in out if r.component == j}
        want = {i: float((np.floor(256 * np.array(v, float)) - x.mean(axis=0)) @ units[:, j - 1]) for i, v in enumerate(vectors)}
        signs = {math.copysign(1, mine[i] * want[i]) for i in want if abs(want[i]) > 1e-3}
        assert len(signs) == 1


@pytest.mark.parametrize("spread", [0, 3, 12])
def test_pairs_of_operators(spread):
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.standard_normal((70, 70)))
    values = np.sort(np.logspace(0, -spread, 70) if spread else np.array([2.0] * 3 + [1.0] * 67))[::-1]
    a = (q * values) @ q.T
    calls = []

    def product(w):
        calls.append(w.shape[1])
        return a @ w

    got, units = whitening.largest_pairs(product, 70, 4, float(values.sum()))
    assert np.abs(got - values[:4]).max() < 1e-13 * values[0]
    assert np.linalg.norm(a @ units - units * got, axis=0).max() < 1e-12 * values[0]
    assert np.abs(units.T @ units - np.eye(4)).max() < 1e-13
    assert len(calls) < 70  # block products, that is passes over the data


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (1, [1.0, 0.0, 0.5], "a"),
        (1, [1.0, 0.0, 0.5], "a"),
        (2, [0.0, -0.0, 0.25], "b"),
        (3, None, "c"),
        (4, [1.0, None, 2.0], "c"),
        (5, [nan, 1.0, 2.0], "c"),
        (6, [inf, 1.0, 2.0], "c"),
        (7, [0.0, 2.0], "c"),  # as if followed by 0
        (None, [3.0, 1.0, -1.0], "c"),
        (8, [], "c"),
    ]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, x string").selectExpr("*", "x as n", "x as block")
    got = whitening.whiten(df).collect()
    assert sorted({r.vec_id for r in got if r.vec_id is not None}) == [1, 2, 7, 8]
    assert len(got) == 6 * 3 and {r.n for r in got} == {5}
    x = np.array([[256, 0, 128], [0, 0, 64], [0, 512, 0], [768, 256, -256], [0, 0, 0]])
    mine = {r.vec_id: r.deviation for r in got}
    assert mine[7] == int(((5 * x[2] - x.sum(axis=0)) ** 2).sum())
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.filter("vec_id = 1")).collect() == []  # one distinct vector has no direction
    huge = spark.createDataFrame([(i, [1e300 * (i % 2), float(i)]) for i in range(6)], "vec_id long, embedding array<double>")
    assert all(r.deviation is None for r in whitening.whiten(huge).collect())


def test_deviations_are_exact():
    x = np.array([[2**40, -(2**40)], [2**40 + 1, 3]])
    got = whitening.deviations(x, 3, [2**41, 5])
    want = [sum((3 * v - s) ** 2 for v, s in zip(row, (2**41, 5))) for row in x.tolist()]
    assert got == [v if v < 2**63 else None for v in want]
    assert whitening.deviations(np.array([[10**6, 1]]), 10**3, [1, 1]) == [(10**9 - 1) ** 2 + 999**2]


# Importance ----------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _brute_resample(docs, target, percent=10, least=20, buckets=10_000, ngram=1):
    def features(text):
        words = WORD.findall((text or "").translate(LOWER))
        return len(words), [
            zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets
            for n in range(1, ngram + 1)
            for i in range(len(words) - n + 1)
        ]

    source, wanted = [0] * buckets, [0] * buckets
    for texts, into in (((t for _, t in docs), source), (target, wanted)):
        for t in texts:
            for b in features(t)[1]:
                into[b] += 1
    gain = [
        math.floor(1000 * math.log((t + 1) * (sum(source) + buckets) / ((s + 1) * (sum(wanted) + buckets))))
        for s, t in zip(source, wanted)
    ]
    scored = []
    for doc_id, text in docs:
        n_words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        key = "" if doc_id is None else str(doc_id)
        h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
        scored.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    able = sorted((r for r in scored if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = [(*r[:4], i + 1) for i, r in enumerate(able[: len(able) * percent // 100])]
    rest = [(*r[:4], None) for r in [*able[len(drawn) :], *(r for r in scored if r[4] < least)]]
    return sorted(drawn + rest, key=repr)


@pytest.mark.parametrize("ngram, percent, buckets", [(1, 10, 10_000), (2, 50, 97), (3, 100, 10_000), (1, 0, 10_000)])
def test_resampling_equals_brute_force(spark, ngram, percent, buckets):
    docs = [(i * 7 % 201, prose(i, 5 + i % 90).title()) for i in range(150)]
    docs += [(500 + i, prose(3, 40)) for i in range(60)] + [(900, "Émile ÀÉ école_x 12 'a'"), (901, None), (902, "")]
    target = [prose(i, 30) for i in range(0, 40, 8)] + [None]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = rows(importance.resample(df, wanted, percent=percent, buckets=buckets, ngram=ngram))
    assert got == _brute_resample(docs, target, percent, buckets=buckets, ngram=ngram)


def test_words_have_offsets_across_pieces():
    text = "Über ALLES, x_y 42 naïve\nVeryLong" + "z" * 50 + " fin"
    found = list(importance.words_with_offsets(text, size=7))
    assert [w for w, _ in found] == WORD.findall(text.translate(LOWER))
    assert all(text[b:e].translate(LOWER) == w for w, (b, e) in found)
    pair = list(importance.windows(found, 2))
    assert pair[0] == ("Über alles", (0, 10)) and len(pair) == len(found) - 1
    splitter, known = importance.pre_tokenizer(), importance._Buckets(1000)
    long = prose(5, 400)
    whole = importance._features(long, splitter, known, 3)
    cut = importance._features(long, splitter, known, 3, size=11)
    assert whole[0] == cut[0] and sorted(whole[1]) == sorted(cut[1])


def test_resampling_of_awkward_rows(spark, awkward, empty):
    target = spark.createDataFrame([("alpha beta", "x")], "text string, score string")
    docs = [(d, t) for d, t, *_ in AWKWARD]
    assert rows(importance.resample(awkward, target, percent=60)) == _brute_resample(docs, ["alpha beta"], 60)
    assert importance.resample(empty, target).collect() == []
    assert rows(importance.resample(awkward, target.limit(0))) == _brute_resample(docs, [])


def test_repeated_rows_are_ranked_one_after_the_other(spark):
    docs = [(7, prose(1, 30))] * 500 + [(i, prose(i, 30)) for i in range(100, 600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    target = spark.createDataFrame([(prose(1, 30),)], "text string")
    got = importance.resample(df, target, percent=80).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 801))
    assert rows(importance.resample(df, target, percent=80)) == _brute_resample(docs, [prose(1, 30)], 80)
