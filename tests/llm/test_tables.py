"""Operators on vectors, URLs and labels; components; the pipeline."""

import math
import random

import numpy as np
import pytest
from conftest import rows
from llm_data import AWKWARD, awkward, empty, prose  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from pairloom.llm import components, hnsw, mixing, url_filter, url_labels

# Components ----------------------------------------------------------------------------


def brute_components(edges):
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((n, find(n)) for n in root)


@pytest.mark.parametrize("kind", ["random", "path", "star"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(130)],
        "path": [(i, i + 1) for i in range(70)],
        "star": [(500, i) for i in range(90)],
    }[kind]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges + edges[:5], "a long, b long")
    assert rows(components.connected_components(df)) == sorted(brute_components(edges), key=repr)


def test_components_of_nothing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert components.connected_components(df).collect() == []


# Nearest neighbours --------------------------------------------------------------------


def brute_nearest(points, queries, k):
    out = {}
    for q in queries:
        score = sorted(((-float(np.dot(points[q], v)), i) for i, v in points.items() if i != q))
        out[q] = [(i, -s) for s, i in score[:k]]
    return out


@pytest.mark.parametrize("shard_rows, scale", [(10**6, 0.0), (700, 0.5)])
def test_nearest_recall_and_scores(spark, shard_rows, scale):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(3000, 24)) * np.exp(scale * rng.normal(size=(3000, 1)))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) ** (1 if scale == 0 else 0)
    points = {i: v for i, v in enumerate(vectors)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in points.items()], "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, k=20, every=20, shard_rows=shard_rows).collect()
    want = brute_nearest(points, range(0, 3000, 20), 20)
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(want)
    hits = 0
    for q, mine in found.items():
        mine.sort()
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        for _, i, s in mine:
            assert s == pytest.approx(float(np.dot(points[q], points[i])), rel=1e-12)
        hits += len({m[1] for m in mine} & {i for i, _ in want[q]})
    assert hits >= 0.9 * 20 * len(want)


def test_nearest_of_awkward_vectors(spark):
    good = [(i, [math.cos(i), math.sin(i), 0.5]) for i in range(0, 60)]
    bad = [
        (100, None),
        (120, [0.0, 0.0, 0.0]),
        (140, [1.0, None, 1.0]),
        (160, [1.0, float("nan"), 1.0]),
        (180, [1.0, float("inf"), 1.0]),
        (200, [1.0, 2.0]),  # alone with its length
        (None, [1.0, 2.0, 3.0]),
        (0, [math.cos(0), math.sin(0), 0.5]),
    ]
    copies = [(i, [1.0, 0.0, 0.5]) for i in range(1000, 1040)]
    df = spark.createDataFrame(good + bad + copies, "vec_id long, embedding array<double>")
    df = df.withColumn("shard", F.lit("own")).withColumn("norm", F.lit(None))
    got = hnsw.nearest(df, k=20).collect()
    points = {i: np.array(v) for i, v in good + copies}
    want = brute_nearest(points, [i for i in points if i % 20 == 0], 20)
    found = {q: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in want}
    assert {r.query_id for r in got} == set(want)
    for q in want:
        assert [i for i, _ in found[q]] == [i for i, _ in want[q]]


def unequal_vectors(kind):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(3000, 24))
    if kind == "lognormal":
        vectors *= np.exp(rng.normal(size=(3000, 1)))
    elif kind == "one is 10,000 times longer":
        vectors[7] *= 10_000
    elif kind == "overflow":
        vectors[::50] *= 1e200
    elif kind == "underflow":
        vectors[::3] *= 1e-170
    elif kind == "subnormal":
        vectors = np.ldexp(vectors, -1060)
    return vectors


@pytest.mark.parametrize("kind", ["lognormal", "one is 10,000 times longer", "overflow", "underflow", "subnormal"])
def test_nearest_recall_with_unequal_norms(spark, kind):
    vectors = unequal_vectors(kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {}
    for r in hnsw.nearest(df, k=20, every=20, shard_rows=700).collect():
        assert not math.isnan(r.score)
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = wanted = 0
    with np.errstate(over="ignore", under="ignore"):
        for q in range(0, 3000, 20):
            power = np.frexp(np.abs(vectors).max(axis=1))[1]
            scaled = np.ldexp(vectors, -power[:, None])
            score = np.ldexp((scaled * scaled[q]).sum(axis=1), power + power[q])
            score[q] = np.nan
            least = -np.sort(-score[~np.isnan(score)])[19]
            assert len(found[q]) == 20
            # ties at the end, such as products that underflow to 0, are equally good
            hits += sum(score[i] >= least for i in found[q])
            wanted += 20
            assert all(s == score[i] or s == pytest.approx(score[i], rel=1e-12) for i, s in found[q].items())
    assert hits >= 0.9 * wanted


def test_nearest_of_repeated_ids_and_rows(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(900, 8))
    # id 0 stands on a third of all rows, each with its own vector; one row is repeated 300 times
    ids = [0] * 300 + list(range(1, 601))
    data = [(i, v.tolist()) for i, v in zip(ids, vectors)] + [(601, vectors[5].tolist())] * 300
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {}
    for r in hnsw.nearest(df, k=20, shard_rows=200).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    best = {}
    for i, v in data:
        if i % 20 == 0:
            for j, w in {(j, tuple(w)) for j, w in data}:
                if j != i:
                    best[i, j] = max(best.get((i, j), -math.inf), float(np.dot(v, w)))
    want = {q: {j for _, j in sorted((-s, j) for (a, j), s in best.items() if a == q)[:20]} for q in found}
    assert set(want) == {0, *range(20, 601, 20)}
    assert all(len(x) == 20 for x in found.values())
    assert sum(len(found[q] & want[q]) for q in want) >= 0.9 * 20 * len(want)


def test_vectors_of_each_length_find_their_own(spark):
    data = [(i, [1.0, float(i)]) for i in range(30)] + [(100 + i, [1.0, float(i), 2.0]) for i in range(9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = {}
    for r in hnsw.nearest(df, k=5).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(x)] for q, x in found.items()} == {
        0: [1, 2, 3, 4, 5],
        20: [29, 28, 27, 26, 25],
        100: [101, 102, 103, 104, 105],
    }


def test_nearest_with_fewer_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 1.0]), (21, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = rows(hnsw.nearest(df), "query_id", "rank", "vec_id", "score")
    assert got == [(0, 1, 20, 0.5), (0, 2, 21, 0.0), (20, 1, 21, 1.0), (20, 2, 0, 0.5)]
    assert hnsw.nearest(df.limit(0)).collect() == []


# URLs ----------------------------------------------------------------------------------

URLS = [
    "https://Example.NET/en/1?x=/de/",
    "http://a.example.net/de/",
    "http://example.com/de/x",
    "http://notexample.com/de/x",
    "http://b.org/fr/",
    "http://b.org/FR/",
    "http://b.org?q=/fr/",
    "http://x.net",
    "ftp://x.net#frag/",
    "nothing",
    "",
    None,
    "a://b://c.net/en/",
    "://net/",
]


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for stop in "?#":
        rest = rest.split(stop, 1)[0]
    host = rest.split("/", 1)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, rest[len(host) :]


def brute_rule(host, path):
    fits = [
        r
        for r in url_filter.RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return (best.name, best.verdict) if best else (None, None)


def test_urls_like_the_rules(spark):
    data = [(i, u, "own") for i, u in enumerate(URLS * 2)]
    got = url_filter.judge(spark.createDataFrame(data, "page_id long, url string, host string")).collect()
    assert len(got) == len(data)
    for r in got:
        host, path = brute_parts(data[r.page_id][1])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_url_model_generalises(spark):
    rng = random.Random(0)

    def url(bad):
        name = rng.choice(["spam", "casino", "cheap"] if bad else ["news", "wiki", "school"])
        return f"http://{name}{rng.randrange(10**6)}.com/{rng.choice('abc')}/{rng.randrange(999)}"

    data = [(url(i % 3 == 0), "block" if i % 3 == 0 else "allow") for i in range(900)]
    train = spark.createDataFrame(data[:600], "url string, verdict string")
    test = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(data[600:])], "page_id long, url string, truth string")
    out = url_filter.judge(test, (), train).join(test.select("page_id", "truth"), "page_id")
    assert out.filter("verdict = truth").count() >= 0.97 * 300


def test_gradient_matches_numpy(spark):
    data = [(f"http://h{i}.com/{'ab'[i % 2]}", "block" if i % 2 else "allow") for i in range(12)]
    df = spark.createDataFrame(data, "url string, verdict string")
    model = url_filter.train(df, steps=3)
    grams = {
        r.url: r.g for r in url_filter.with_parts(df.select("url")).select("url", url_filter.grams().alias("g")).collect()
    }
    x = np.zeros((12, url_filter.BUCKETS))
    bend = np.full(url_filter.BUCKETS, url_filter.DAMPING)
    for i, (u, _) in enumerate(data):
        for g in grams[u]:
            x[i, g] += 1 / math.sqrt(len(grams[u]))
            bend[g] += 0.25 / len(grams[u]) / 12
    y = np.array([v == "block" for _, v in data], float)
    w = np.zeros(url_filter.BUCKETS)
    for _ in range(3):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - url_filter.RATE * (x.T @ (p - y) / 12 + url_filter.RIDGE * w) / bend
    assert np.allclose(w, model.weights, atol=1e-6)


def test_urls_without_training_rows(spark):
    df = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "url string, verdict string")
    assert url_filter.judge(df, labelled=none).first().verdict == "allow"
    assert url_filter.judge(df).first().verdict == "allow"
    assert url_filter.judge(df.limit(0)).collect() == []


def test_held_out_accuracy_on_labelled_urls(spark):
    table = url_labels.url_labels(spark)
    held = F.pmod(F.xxhash64("host_name"), F.lit(4)) == 0  # hosts apart, not only URLs
    test = table.filter(held).withColumn("page_id", F.monotonically_increasing_id()).cache()
    got = url_filter.judge(test.select("page_id", "url"), (), table.filter(~held))
    counts = {
        (r.truth, r.verdict): r["count"]
        for r in got.join(test.select("page_id", F.col("verdict").alias("truth")), "page_id").groupBy("truth", "verdict").count().collect()
    }
    blocked = sum(n for (t, _), n in counts.items() if t == "block")
    allowed = sum(n for (t, _), n in counts.items() if t == "allow")
    assert counts["block", "block"] >= 0.9 * blocked
    assert counts["allow", "allow"] >= 0.95 * allowed


def test_urls_of_any_length_and_clashing_names(spark):
    long = "http://casino-" + "x" * 200_000 + ".com/" + "y" * 200_000
    data = [(1, long, 1, 1), (1, long, 1, 1), (2, None, 1, 1), (None, "", 1, 1)]
    df = spark.createDataFrame(data, "page_id long, url string, grams int, label int").withColumn("p_block", F.lit("own"))
    got = url_filter.judge(df).collect()
    assert sorted(len(r.path) for r in got) == [0, 0, 200_001, 200_001]
    assert len({r.verdict for r in got if r.path}) == 1


def test_samples_are_the_smallest_hashes_and_no_window_spans_a_verdict(spark):
    df = spark.range(50).selectExpr("concat('http://h', id, '.com/') as url", "if(id % 2 = 0, 'block', 'allow') as verdict")
    want = {}
    for r in df.select("url", "verdict", F.xxhash64("url").alias("h")).collect():
        want.setdefault(r.verdict, []).append((r.h, r.url))
    few = spark.createDataFrame([(u, v) for v, x in want.items() for _, u in sorted(x)[:7]], "url string, verdict string")
    part, whole = url_filter.train(df, sample=7), url_filter.train(few)
    assert part.intercept == whole.intercept and np.allclose(part.weights, whole.weights)


# Mixing --------------------------------------------------------------------------------


def test_rates_meet_targets_and_solve_least_squares(spark):
    rng = np.random.default_rng(5)
    shares = rng.dirichlet([0.3, 0.3, 0.3], 400)
    tokens = rng.integers(1, 200, 400)
    df = spark.createDataFrame(
        [(int(t), *map(float, p)) for t, p in zip(tokens, shares)], "tokens long, p_a double, p_b double, p_c double"
    )
    targets = {"a": 0.5, "b": 0.2, "c": 0.3}
    got = mixing.fit_rates(df, targets).collect()
    assert min(r.rate for r in got) >= 0
    for d, want in targets.items():
        reached = sum(r.tokens * r.rate * r[f"p_{d}"] for r in got)
        assert reached == pytest.approx(want * tokens.sum(), abs=0.005 * tokens.sum())
    # the same steps in numpy
    rate = np.ones(400)
    want = tokens.sum() * np.array([0.5, 0.2, 0.3])
    for _ in range(mixing.STEPS):
        off = (tokens * rate) @ shares - want
        if np.abs(off).max() <= mixing.CLOSE * tokens.sum():
            break
        g = (shares * (tokens * (rate > 0))[:, None]).T @ shares
        rate = np.maximum(0, rate - shares @ np.linalg.solve(g + mixing.RIDGE * np.diag(np.diag(g)), off))
    mine = sorted((r.tokens, r.p_a, r.rate) for r in got)
    theirs = sorted(zip(tokens.tolist(), shares[:, 0].tolist(), rate.tolist()))
    assert np.allclose(mine, theirs, rtol=1e-6)


def test_domains_are_told_apart(spark):
    docs, labels = [], []
    for i in range(600):
        kind = i % 3
        extra = [" nice", " awful", " !!!! $$$$ %%%% !!!! ####"][kind]
        docs.append((i, prose(i, 30) + extra))
        if i % 2:
            labels.append((i, int(kind == 0), int(kind == 1)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = mixing.mix(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 600
    for r in got:
        p = [r.p_good, r.p_toxic, r.p_poor]
        assert sum(p) == pytest.approx(1) and int(np.argmax(p)) == r.doc_id % 3
    assert min(r.rate for r in got if r.doc_id % 3 == 0) >= 1
    assert max(r.rate for r in got if r.doc_id % 3) < 0.5


def test_posteriors_equal_naive_bayes(spark):
    rng = random.Random(4)
    names = {"good": "calm river stone".split(), "poor": "buy click now".split()}
    data = []
    for i in range(120):
        domain = ("good", "poor")[i % 2]
        own = [rng.choice(names[domain] + ["and", "the"]) for _ in range(rng.randrange(1, 9))]
        data.append((i, " ".join(own), domain))
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, d) for i, _, d in data[:80]], "doc_id long, domain string")
    domains = ["good", "poor"]
    model = mixing.learn(docs, labels, domains)
    got = {r.doc_id: [r.p_good, r.p_poor] for r in mixing.posteriors(docs, model, domains).collect()}
    # brute force: presence of each known word or form, rates smoothed by a half
    known = [r.word for r in model.words.collect()]
    present = lambda t: set(t.split(" ")) | {" repeated=0"}
    seen = {d: [present(t) for _, t, x in data[:80] if x == d] for d in domains}
    for i, text, _ in data:
        logs = []
        for d in domains:
            total = math.log((len(seen[d]) + 0.5) / 81)
            for w in known:
                rate = (sum(w in s for s in seen[d]) + 0.5) / (len(seen[d]) + 1)
                total += math.log(rate if w in present(text) else 1 - rate)
            logs.append(total)
        top = max(logs)
        want = [math.exp(x - top) / sum(math.exp(y - top) for y in logs) for x in logs]
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_labels_without_documents_play_no_part(spark):
    domains = ["good", "poor"]
    docs = [(i, prose(i, 30) + (" nice" if i % 2 else " awful")) for i in range(120)]
    labels = [(i, domains[1 - i % 2]) for i in range(120)]
    absent = [(i, "good" if i % 5 else "poor") for i in range(1000, 9000)]
    d = spark.createDataFrame([*docs, (1000, None), (1001, "")], "doc_id long, text string")
    of = [spark.createDataFrame(x, "doc_id long, domain string") for x in (labels, labels + absent)]
    known, more = (mixing.learn(d, x, domains, sample=50) for x in of)
    assert known.start == pytest.approx(more.start)
    assert {"nice", "awful"} <= {r.word for r in more.words.collect()}
    assert rows(known.words) == rows(more.words)


def test_mixing_of_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 0), (9, 1, 1), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert mixing.mix(awkward, labels).count() == len(AWKWARD)
    assert mixing.mix(awkward, labels.limit(0)).count() == len(AWKWARD)
    assert mixing.mix(empty, labels).collect() == []


# Pipeline ------------------------------------------------------------------------------


def test_mixing_keeps_clean_documents_where_nearly_all_are_clean(spark, tmp_path):
    docs, labels = [], []
    for i in range(1000):
        kind = "poor" if i % 50 == 1 else "toxic" if i % 100 == 2 else "good"
        docs.append((i, prose(i, 30) + {"good": " nice", "poor": " awful", "toxic": " !!!! $$$$ %%%%"}[kind]))
        labels.append((i, int(kind == "good"), int(kind == "toxic")))
    docs.append((0, docs[2][1]))  # a toxic text with the id of a good one
    d = spark.createDataFrame(docs, "doc_id long, text string")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    mixed = corpus_pipeline.mixing(spark, d, str(tmp_path))
    times = {(r.doc_id, r.text): r["count"] for r in mixed.groupBy("doc_id", "text").count().collect()}
    assert all(times.get(x, 0) >= 1 for x in docs if x[1].endswith("nice"))
    assert all(n == 1 for (_, text), n in times.items() if not text.endswith("nice"))


def test_stages_of_awkward_rows(spark, awkward):
    sf = "/root/testdata/sf0.001"
    kept = corpus_pipeline.language_id(spark, awkward, sf)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 7, 8, None, 9, 11, 12}
    kept = corpus_pipeline.near_duplicates(spark, awkward, sf)
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    # 2 is a copy of 1 but for case, 3 differs in its end, 8 repeats 7, and 1 is there twice
    assert ids == sorted([1, 4, 5, 6, 7, 9, 10, 11, 12, None], key=repr)
    mixed = corpus_pipeline.mixing(spark, awkward, sf)
    assert mixed.columns == awkward.columns


def test_one_row_of_each_group_of_texts_stays(spark):
    a, b, c, d = (prose(i, 60) for i in (1, 2, 4, 5))
    docs = [(1, a), (5, a), (5, b), (7, b), (None, c), (None, c), (None, c), (None, d), (2, d + " more"), (9, " "), (9, " "), (None, ""), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = rows(corpus_pipeline.near_duplicates(spark, df, ""))
    assert got == sorted([(1, a), (5, b), (None, c), (2, d + " more"), (9, " "), (None, ""), (None, "")], key=repr)


def test_pipeline_end_to_end(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_pieces", "pieces", "lossless"]
    got = out.collect()
    assert got and all(r.lossless and r.n_pieces == len(r.pieces) for r in got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "mixing", "pieces"]
