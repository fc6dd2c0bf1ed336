import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginlab.llm import exact_dedup, graph, near_duplicates
from loginlab.llm.near_duplicates import shingles


def test_exact_dedup_query(spark, folder, odd_documents):
    got = exact_dedup.op5_exact_dedup(spark, folder).collect()
    groups = defaultdict(list)
    for i, text in odd_documents:
        groups[text or ""].append(i)
    assert len(got) == len(odd_documents)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in set(ids):
            rows = [r for r in by_id[i] if r.group_size == len(ids) and r.keep_id == keep]
            assert len(rows) >= ids.count(i)
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.kept is False or r.doc_id == r.keep_id for r in got)


def test_exact_dedup_matches_sql(spark, documents, sql, same, tmp_path):
    unique = documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    unique.write.parquet(f"{tmp_path}/documents.parquet")
    got = exact_dedup.op5_exact_dedup(spark, str(tmp_path)).toPandas()
    same(got, sql(exact_dedup.ORACLE_SQL, tmp_path, "documents"))


def test_texts_that_share_a_digest_are_told_apart(spark):
    r = random.Random(4)
    rows = [(r.randrange(30), r.choice(["a", "b", "c", "dd", "ee", "", None]), k) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(4)
    weak = lambda text: F.length(text).cast("string")
    found = exact_dedup.copies(docs, digest=weak).collect()
    groups = Counter(t or "" for _, t, _ in rows)
    largest = {t: max(i for i, x, _ in rows if (x or "") == t) for t in groups}
    assert Counter((x.keep_id, x.group_size) for x in found) == Counter(
        {(largest[t], n): 0 for t, n in groups.items()}
    ) + sum((Counter({(largest[t], n): n}) for t, n in groups.items()), Counter())
    assert sum(x.kept for x in found) == len(groups)
    left = exact_dedup.drop_copies(docs, digest=weak)
    assert left.columns == docs.columns
    assert Counter((x.doc_id, x.text or "") for x in left.collect()) == Counter((i, t) for t, i in largest.items())


def test_drop_copies_keeps_one_row_of_each_text(documents, odd_documents):
    left = exact_dedup.drop_copies(documents)
    assert left.columns == documents.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t in odd_documents})
    assert exact_dedup.copies(documents.where("false")).count() == 0
    assert exact_dedup.drop_copies(documents.where("false")).count() == 0


def test_state_goes_on_with_new_files(spark, tmp_path):
    def land(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        exact_dedup.fingerprints(docs).write.mode("append").parquet(f"{tmp_path}/landed")

    land([(1, "a"), (2, "b"), (3, "a")])
    kind = spark.read.parquet(f"{tmp_path}/landed").schema
    for more in ([], [(9, "b"), (0, "a"), (4, "c")]):
        if more:
            land(more)
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/landed")
        exact_dedup.remember(stream, f"{tmp_path}/state")
    state = exact_dedup.remembered(spark, f"{tmp_path}/state").collect()
    assert Counter((r.stays.id, r.n) for r in state) == Counter([(3, 3), (9, 2), (4, 1)])


def test_components(spark):
    r = random.Random(1)
    chain = list(range(200))
    r.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((1000, 1000 + k) for k in range(300)), (5000, 5001), (5001, 5000), (7, 7)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(200)) and all(got[1000 + k] == 1000 for k in range(300)) and got[5001] == 5000
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def by_hand(rows, threshold=0.8):
    """⟨set_id, class_id, copies, links⟩ of each set of shingles."""
    ids = defaultdict(list)
    for i, text in rows:
        ids[tuple(shingles(text).tolist())].append(i)
    sets = [k for k in ids if k]
    first = {k: min((i for i in ids[k] if i is not None), default=None) for k in sets}
    near = defaultdict(set)
    for a, x in enumerate(sets):
        for y in sets[:a]:
            both = len(set(x) & set(y))
            if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                near[x].add(y)
                near[y].add(x)
    out = {}
    for x in sets:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        out[x] = (first[x], min((first[y] for y in seen if first[y] is not None), default=None), len(ids[x]), len(near[x]))
    return out


@pytest.fixture(scope="module")
def near_rows(odd_documents):
    """Groups of near copies, documents with a common passage, short texts and odd ones."""
    r = random.Random(9)
    words = [f"word{k}" for k in range(3000)]
    rows = list(odd_documents)
    passage = r.choices(words, k=60)
    for g in range(6):
        base = r.choices(words, k=r.choice([6, 40, 200]))
        for _ in range(r.choice([2, 5, 90])):
            text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows) + 100, " ".join(text)))
    for _ in range(120):
        rows.append((len(rows) + 100, " ".join(passage + r.choices(words, k=r.randrange(30, 200)))))
    for k in range(8):
        rows.append((len(rows) + 100, " ".join(words[: k + 1])))
    return rows


@pytest.mark.parametrize("tight", [False, True])
def test_near_duplicates_are_those_of_all_pairs(spark, near_rows, monkeypatch, tight):
    if tight:  # all the ways of splitting
        monkeypatch.setattr(near_duplicates, "LARGE", 20)
        monkeypatch.setattr(near_duplicates, "SMALL", 5)
        monkeypatch.setattr(near_duplicates, "BLOCK", 900)
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in near_rows], "doc_id long, text string, n int, rec string")
    got = near_duplicates.links(docs.repartition(3)).collect()
    assert len(got) == len(near_rows)
    want = by_hand(near_rows)
    keys = {tuple(shingles(t).tolist()) for _, t in near_rows} - {()}
    per_set = {bytes(r.set_key): (r.set_id, r.class_id, r.n_copies, r.n_links) for r in got}
    digest = lambda k: near_duplicates.hashlib.blake2b(np.array(k, np.uint64).tobytes(), digest_size=16).digest()
    for k in keys:
        assert per_set[digest(k)] == want[k]
    empty = [r for r in got if bytes(r.set_key) == digest(())]
    assert all(r.class_id == r.doc_id and r.n_links == 0 and r.n_copies == 1 for r in empty) and len(empty) == 4


def test_one_of_each_class_stays(spark, near_rows):
    docs = spark.createDataFrame([(i, t, 1) for i, t in near_rows if i is not None], "doc_id long, text string, n int")
    left = near_duplicates.one_of_each(docs)
    assert left.columns == docs.columns
    rows = [(i, t) for i, t in near_rows if i is not None]
    classes = {c for _, c, _, _ in by_hand(rows).values()} | {i for i, t in rows if not len(shingles(t))}
    assert sorted(r.doc_id for r in left.collect()) == sorted(classes)
    assert near_duplicates.one_of_each(docs.where("false")).count() == 0


def test_classes_with_null_and_repeated_ids_do_not_compete(spark):
    r = random.Random(12)
    text = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b, c, d, e = (text(40) for _ in range(5))
    rows = [(None, a), (None, b), (None, a + " more"), (5, c), (5, d), (5, c + " more"), (None, d), (8, e), (None, e)]
    rows += [(None, "!"), (None, "?"), (None, None), (5, "--"), (6, "...")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = near_duplicates.one_of_each(docs)
    assert left.columns == docs.columns
    want = [(None, a), (None, b), (5, c), (5, d), (8, e), (None, "!"), (None, "?"), (None, None), (5, "--"), (6, "...")]
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, want))
    found = near_duplicates.links(docs).collect()
    assert len(found) == len(rows) and len({x.class_key for x in found}) == len(want)


def test_join_query(spark, folder, odd_documents):
    got = near_duplicates.op6_ngram_jaccard_join(spark, folder)
    assert got.columns == ["doc_id", "class_id", "set_id", "n_copies", "n_links"]
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[11].class_id == 0 and rows[11].n_links == 1 and rows[7].set_id == 0 and rows[7].n_copies == 4 - 1
