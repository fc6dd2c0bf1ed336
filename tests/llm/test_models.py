import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loginlab.llm import common, languages, nearest
from loginlab.llm.near_duplicates import shingles
from tests.llm.test_tokens import packed_well


def best(vectors, i, k):
    """The k best of ⟨id, vector⟩ for the query in place i."""
    q, own = np.array(vectors[i][1], float), vectors[i][0]
    found = sorted((-float(np.dot(np.array(v, float), q)), j) for j, v in vectors if j != own)
    return [(j, -s) for s, j in found[:k]]


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((8, 20))
    rows = [(i, (centre[i % 8] * (1 + i % 3) + rng.standard_normal(20) * 0.7).astype("f4").tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[5][1]) for i in range(150)]  # a hot vector
    return rows + [(3000, rows[5][1]), (3000, rows[5][1])]


def table_of(spark, rows, path):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, q int, list int")
    df.repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def test_search_reaches_the_recall(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "VECTORS", 200)
    monkeypatch.setattr(nearest, "QUERIES", 20)
    monkeypatch.setattr(nearest, "LIST_SIZE", 100)
    bad = [(20, None), (40, []), (4000, [0.0] * 20), (4020, [None] * 20), (4040, [float("nan")] * 20), (4060, [1.0] * 19), (None, [1.0] * 20)]
    rows = [v for v in vectors if v[0] not in (20, 40)]
    found = nearest.op8_nearest_neighbours(spark, table_of(spark, rows + bad, tmp_path)).collect()
    plain = list(dict((i, v) for i, v in rows).items())
    hits = total = 0
    for n, (i, _) in enumerate(plain):
        got = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == i)
        if i % 20:
            assert not got
            continue
        want = best(plain, n, 20)
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        hits += len({v for v, _ in want} & {v for _, v, _ in got})
        total += 20
        exact = dict(best(plain, n, len(plain)))
        assert all(abs(exact[v] - s) < 1e-9 for _, v, s in got)
    assert hits / total >= 0.9
    assert not {r.query_id for r in found} & {20, 40, 4000, 4020, 4040, 4060}


def test_one_list_is_exact_with_ties(spark, vectors):
    df = spark.createDataFrame(vectors, "id long, vector array<float>")
    found = nearest.neighbours(df, F.col("id") % 500 == 0, 30, list_size=10_000).collect()
    plain = list(dict(vectors).items())
    for n, (i, _) in enumerate(plain):
        if i % 500 == 0:
            got = [r.id for r in sorted((r for r in found if r.query_id == i), key=lambda r: r["rank"])]
            assert got == [v for v, _ in best(plain, n, 30)]


def test_small_lists_are_topped_up(spark, monkeypatch):
    """One probe only, and groups with fewer vectors than are wanted."""
    monkeypatch.setattr(nearest, "_probes", lambda *_: 1)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.eye(8)[k % 4] * 9 + rng.standard_normal(8) * 0.01]) for k in range(24)]
    rows += [(100 + k, [float(x) for x in rng.standard_normal(8)]) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    found = nearest.neighbours(df, F.col("id") % 20 == 0, 20, list_size=10).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {i: 20 for i, _ in rows if i % 20 == 0}


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [3.0, 0.0])], "id long, vector array<double>")
    found = nearest.neighbours(df, F.col("id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.id, r.score) for r in found] == [(20, 1, 2, 3.0), (20, 2, 1, 0.0)]
    assert nearest.neighbours(df.where("false"), F.col("id") % 20 == 0, 20).count() == 0


def test_the_scan_abandons_no_neighbour_and_most_others():
    rng = np.random.default_rng(1)
    points, queries = rng.standard_normal((3000, 64)), rng.standard_normal((30, 64))
    q, p, _ = nearest.adaptive_scan(points, queries, np.full(30, np.inf), 10)
    far = nearest._squares(queries, points)
    kept = set(zip(q.tolist(), p.tolist()))
    near = [(a, b) for a in range(30) for b in np.argsort(far[a])[:10].tolist()]
    assert sum(x in kept for x in near) / len(near) > 0.97 and len(kept) < far.size / 3


LETTERS = {"aa": "abcde", "bb": "uvwxyz", "cc": "ñçéüß"}


def written(lang, n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(LETTERS[lang]), rng.integers(1, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rows = [(i, written(lang, 5 + i % 60, i), lang) for i in range(240) for lang in [list(LETTERS)[i % 3]]]
    odd = [(500, None, "aa"), (501, "", "bb"), (502, "12 ?! 3", "aa"), (503, "abc", None), (None, "uvw xyz", "aa")]
    return [*rows, *odd, (504, written("aa", 6000, 1), None), (504, written("aa", 6000, 1), None), (505, "漢字 " * 10, None)]


def test_language_query(spark, labelled, tmp_path):
    rows = [(i, t, lang, 0.5, "x") for i, t, lang in labelled]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = languages.op9_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(labelled) and got[0].asDict().keys() == {"doc_id", "held_out", "lang_pred", "score"}
    true = {i: lang for i, _, lang in labelled}
    out = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.held_out]
    assert len(out) > 20 and np.mean([r.lang_pred == true[r.doc_id] for r in out]) > 0.95
    for r in got:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (500, 501, 502))
    assert {r.lang_pred for r in got if r.doc_id == 504} == {"aa"}


def test_held_out_labels_are_not_learned_from(spark, labelled):
    names = "doc_id long, text string, lang string"
    plain = languages.learn(spark.createDataFrame(labelled, names))
    wrong = [(i, t, "zz" if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in labelled]
    other = languages.learn(spark.createDataFrame(wrong, names))
    assert plain.languages == other.languages and np.array_equal(plain.weights, other.weights)


def test_nothing_to_learn_from(spark, labelled):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = languages.learn(docs)
    assert [r.lang_pred for r in languages.identify(docs, model).collect()] == ["und"]
    assert languages.identify(docs.where("false"), model).count() == 0
    assert languages.learn(docs.where("false")).languages == []


def test_texts_of_many_languages_stay(spark):
    r, letters = np.random.default_rng(8), ["abcd", "efgh", "ijkl", "mnop", "qrst"]
    word = lambda k: "".join(r.choice(list(letters[k]), 5))
    rows = [(n, " ".join(word(n % 5) for _ in range(30)), f"l{n % 5}") for n in range(60)]
    rows += [(100, " ".join(word(k) for k in range(5) for _ in range(20)), None), (101, "1 2 3", None), (102, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = {x.doc_id: x.score for x in languages.identify(docs, languages.learn(docs)).collect()}
    assert 0 < judged[100] < 0.3
    assert sorted(x.doc_id for x in languages.keep_identified(docs).collect()) == [*range(60), 100]


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(languages, "NUMBERS", 1_500_000)  # several parts
    rng, rows = np.random.default_rng(6), []
    for k in range(70):
        own = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(12)]
        rows += [(len(rows) + n, " ".join(rng.choice(own, 15)), f"l{k:02}") for n in range(10 if k else 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.learn(docs)
    assert model.languages == sorted({r[2] for r in rows}) and len(model.languages) == 70
    found = languages.judge([t for _, t, _ in rows], model)
    assert np.mean([x[0] == lang for x, (_, _, lang) in zip(found, rows)]) > 0.95
    monkeypatch.setattr(languages, "MOST_TEXTS", 140)
    seen = []
    monkeypatch.setattr(languages, "fit", lambda texts, labels: seen.extend(labels))
    languages.learn(docs)
    assert set(seen) == set(model.languages) and max(map(seen.count, set(seen))) == 2


def test_code_switched_words_get_their_own_language(labelled):
    rows = [(t, lang) for _, t, lang in labelled if t and lang and len(t) < 8000 and any(map(str.isalpha, t))]
    model = languages.fit([t for t, _ in rows], [lang for _, lang in rows])
    text = written("aa", 30, 1) + " " + written("cc", 30, 2)
    words = languages.words_of([text])
    seen, _ = languages.marginals(languages.emissions(words, model), words.counts, model.transitions)
    assert (seen[:30].argmax(1) == 0).mean() > 0.9 and (seen[30:].argmax(1) == 2).mean() > 0.9


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(2)
    scores, move = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
    paths = np.array(np.meshgrid(*[[0, 1]] * 6, indexing="ij")).reshape(6, -1).T
    weight = np.exp([sum(scores[t, p[t]] for t in range(6)) + sum(move[a, b] for a, b in zip(p, p[1:])) for p in paths])
    want = np.array([[weight[paths[:, t] == y].sum() for y in (0, 1)] for t in range(6)]) / weight.sum()
    for size in (1, 2, 4, 100):
        got, _ = languages.marginals(scores, np.array([6]), move, size)
        assert np.allclose(got, want)


def test_pipeline_on_a_small_corpus(spark, prose, tmp_path):
    rows = [(i, prose(i, 120), "en", "s", 1) for i in range(60)]
    rows += [(100 + i, prose(i, 120), "en", "s", 1) for i in range(20)]  # copies; the larger id stays
    rows += [(200 + i, prose(i, 120) + " one more word", "en", "s", 1) for i in range(10)]  # near copies
    rows += [(300, None, "en", "s", 0), (301, "?! 12", None, "s", 5), (302, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    stay = {}
    for i, text, *_ in rows:
        if text and any(map(str.isalpha, text)):
            stay[text] = max(i, stay.get(text, -1))
    texts = sorted((i, t) for t, i in stay.items())
    kept = []
    for i, t in texts:
        x = set(shingles(t).tolist())
        if not any(len(x & y) >= 0.8 * len(x | y) for _, y in kept):
            kept.append((i, x))
    assert Counter(r.doc_id for r in got if r.piece == 0) == Counter(i for i, _ in kept)
    packed_well(got, 2048)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_a_process_keeps_the_object_of_one_operator():
    made = []
    for key in ("a", "a", "b", "a"):
        common.per_process(key, lambda k=key: made.append(k) or [k])
    assert made == ["a", "b", "a"] and list(common._kept) == ["a"]
    common._kept.clear()
