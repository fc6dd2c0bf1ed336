import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from loginlab.llm import lexical_search, vector_codes, warc
from loginlab.llm.common import join_groups

# ranked lexical search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(items, docs, best):
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    words = sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            if not c:
                continue
            m = 100 - 25 + (25 * c.total() * n_docs) // words
            score = 0
            for t, often in Counter(terms_of(text)).items():
                if t in c:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += often * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, d[3], -d[0]) for r, d in enumerate(sorted(scored, key=lambda x: x[:3])[:best])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(prose):
    return [(1, prose(1, 30)), (2, "漢字 café CAFÉ river river"), (3, None), (4, "nowhere zzz"), (5, prose(9, 200)), (6, "12 345 x_y we'll")]


@pytest.mark.parametrize("slice_size", [500_000, 60, 8])
def test_search_equals_brute_force(spark, items, odd_documents, documents, slice_size):
    asked = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, item int")
    got = lexical_search.search(asked, documents, 5, slice_size=slice_size).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(items, odd_documents, 5)


def test_search_pieces_ties_and_empty_tables(spark, items, documents, monkeypatch):
    text = "Alpha beta-gamma " * 50 + "漢" * 40
    monkeypatch.setattr(lexical_search, "PIECE", 16)
    assert [t.decode() for p in lexical_search.terms(text.encode()) for t in p] == terms_of(text)
    docs = [(n, "alpha beta") for n in (9, 4, 7, 4)] + [(None, "alpha beta"), (1, "other")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    got = lexical_search.search(asked, docs, 4).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [4, 4, 7, 9]
    assert lexical_search.search(asked.limit(0), docs).isEmpty()
    assert lexical_search.search(asked, docs.limit(0)).isEmpty()


def test_heaps_keep_the_best():
    r = np.random.default_rng(1)
    scores, ids = r.integers(0, 6, (300, 3)), [None if k % 50 == 7 else int(k) for k in r.permutation(300)]
    heaps = lexical_search.Heaps(3, 8)
    for a in range(0, 300, 37):
        heaps.update(scores[a : a + 37], ids[a : a + 37])
    for item in range(3):
        want = sorted((-int(s), i is None, i or 0) for s, i in zip(scores[:, item], ids) if s > 0)[:8]
        assert sorted((-s, not known, -i) for s, known, i in heaps.rows[item]) == want


def test_search_query_equals_sql(spark, folder, items, sql, same):
    rows = [(i, t) for i, t in items if i != 3]
    spark.createDataFrame(rows, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    docs.write.mode("overwrite").parquet(f"{folder}/unique/documents.parquet")
    spark.createDataFrame(rows, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/unique/benchmark.parquet")
    got = lexical_search.op11_lexical_search(spark, f"{folder}/unique").toPandas()
    same(got, sql(lexical_search.ORACLE_SQL, f"{folder}/unique", "documents", "benchmark"))


# WARC


PAGES = [
    (1, "http://a/1", "<p>same</p>"),
    (5, "http://a/5", "<p>same</p>"),
    (3, None, "<p>same</p>"),
    (3, "http://b/3", "<p>same</p>"),
    (None, "http://c", "<p>same</p>"),
    (2, "http://a/2", None),
    (7, "http://x\r\nWARC-Type: evil", ""),
    (8, "http://a/8", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\x1f\x8b not a record\r\n\r\n" * 50),
    (9, "http://a/9", "x" * 3_000_000 + "é漢"),
    (10, "http://a/10", "".join(random.Random(3).choices("abcdefgh \n", k=200_000))),
    (None, "http://d", "alone"),
]


def expected(pages, least=0):
    first = {}
    for i, _, h in pages:
        h = (h or "").encode()
        if len(h) >= least:
            first[h] = min(first.get(h, (True, 0)), (i is None, i or 0))
    out = []
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        h = (h or "").encode()
        mine = first.get(h) == (i is None, i or 0)
        if mine:
            first[h] = first[h] + ("taken",)
        again = len(h) >= least and not mine
        got = first.get(h, ())[:2]
        refers = (None if got[0] else got[1]) if again else None
        out.append((i, len(h), warc.digest(h), "revisit" if again else "response", refers))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def page_folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    rows = [(*p, "response", 0) for p in PAGES]
    kinds = "page_id long, url string, html string, record_type string, id int"
    spark.createDataFrame(rows, kinds).repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


def test_warc_query(spark, page_folder):
    got = warc.op12_warc(spark, page_folder).collect()
    assert sorted(map(tuple, got), key=str) == expected(PAGES)


def test_warc_query_equals_sql(spark, page_folder, sql, same):
    rows = spark.read.parquet(f"{page_folder}/pages.parquet").where("page_id IS NOT NULL").dropDuplicates(["page_id"])
    rows.write.mode("overwrite").parquet(f"{page_folder}/unique/pages.parquet")
    got = warc.op12_warc(spark, f"{page_folder}/unique").toPandas()
    same(got, sql(warc.ORACLE_SQL, f"{page_folder}/unique", "pages"))


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbb"), (4, "u", "bbb")], "page_id int, url string, html string")
    got = {r.id: (r.record_type, r.first) for r in warc.revisits(pages, least_bytes=3).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("response", None), 4: ("revisit", 3)}
    assert warc.revisits(pages.limit(0)).isEmpty()


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip_and_push_down(spark, tmp_path, page_folder, compression):
    pages = warc.revisits(spark.read.parquet(f"{page_folder}/pages.parquet"))
    rows = pages.select(F.coalesce(F.col("id").cast("string"), F.lit("none")).alias("record_id"), "record_type", "target_uri",
                        F.col("first").cast("string").alias("refers_to"), "payload")
    path = f"file://{tmp_path}/out"
    warc.write_warc(rows, path, compression=compression, filebytes=100_000, date="2024-01-01T00:00:00Z")
    assert not [f for f in (tmp_path / "out").iterdir() if f.name.startswith("_")]
    found = warc.read_warc(spark, path)
    payloads = sorted((r.record_id, bytes(r.payload)) for r in found.where("record_type = 'response'").collect())
    assert payloads == sorted((r.record_id, bytes(r.payload)) for r in rows.where("record_type = 'response'").collect())
    assert found.where("record_type = 'revisit' AND payload IS NULL").count() == 5
    assert {r.target_uri for r in found.where("record_id = '7'").collect()} == {"http://x%0D%0AWARC-Type: evil"}
    some = found.where("target_uri LIKE 'http://a/%' AND content_length > 1000 AND refers_to IS NULL AND NOT record_id = '9'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan warc" in plan and "StartsWith(target_uri" not in plan
    assert sorted(r.record_id for r in some.select("record_id").collect()) == ["10", "8"]
    again = warc.read_warc(spark, path).where("payload_bytes = 0").count()  # not pushed: not a header
    assert again == 2


def test_unwanted_payloads_are_not_inflated(tmp_path):
    rows = [{"record_id": str(n), "record_type": t, "payload": b"z" + bytes(random.Random(n).randbytes(3_000_000))} for n, t in enumerate(("response", "revisit", "resource"))]
    with open(tmp_path / "a.warc.gz", "wb") as f:
        for r in rows:
            f.write(warc.member(warc.record(r), 6))
    inflated = []
    whole = warc.Packed._more

    def more(self):
        before = len(self.data)
        out = whole(self)
        inflated.append(len(self.data) - before)
        return out

    fs, _ = warc.filesystem(str(tmp_path))
    read = lambda wanted, passes: list(warc.records(fs, str(tmp_path / "a.warc.gz"), wanted, passes))
    warc.Packed._more = more
    try:
        assert [r["payload_bytes"] for r in read({"payload_bytes"}, lambda r: True)] == [3_000_001] * 3
        assert sum(inflated) < 100_000
        inflated.clear()
        got = read({"payload"}, lambda r: warc.test(ds.EqualTo(("record_type",), "resource"), r))
        assert [r["payload"] for r in got] == [rows[2]["payload"]] and sum(inflated) < 3_200_000
    finally:
        warc.Packed._more = whole


def test_archives_of_others(spark, tmp_path):
    plain = (
        b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:0>\r\nContent-Type: application/warc-fields\r\n"
        b"Content-Length: 9\r\n\r\na: b\r\nc:d\r\n\r\n"
        b"WARC/1.0\r\nwarc-type: resource\r\nWARC-Record-ID: <urn:x:1>\r\nWARC-Target-URI: http://e/\r\n  folded\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    )
    (tmp_path / "a.warc").write_bytes(plain)
    half = plain.index(b"WARC/1.0", 10)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(plain[:half]) + gzip.compress(plain[half:]))
    (tmp_path / "note.txt").write_text("not an archive")
    rows = warc.read_warc(spark, str(tmp_path)).orderBy("file", "offset").collect()
    assert [r.record_id for r in rows] == ["urn:x:0", "urn:x:1"] * 2
    assert [bytes(r.payload) for r in rows] == [b"a: b\r\nc:d", b""] * 2
    assert rows[1].target_uri == "http://e/ folded"
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(plain[:half])[:-20])
    with pytest.raises(Exception, match="cut off|no record"):
        warc.read_warc(spark, str(tmp_path / "c.warc.gz"), ["record_id"]).collect()


def test_predicates_follow_sql():
    row = {"record_type": "response", "refers_to": None, "content_length": 5}
    not_equal = lambda c, v: ds.Not(ds.EqualTo((c,), v))
    assert warc.test(not_equal("record_type", "revisit"), row) and warc.test(not_equal("refers_to", "x"), row) is None
    assert warc.test(ds.In(("content_length",), (4, 5)), row) and not warc.test(ds.LessThan(("content_length",), 5), row)
    assert warc.test(ds.EqualNullSafe(("refers_to",), None), row) and warc.test(ds.IsNull(("refers_to",)), row)
    assert not warc.pushable(ds.EqualTo(("payload",), b"")) and warc.pushable(not_equal("file", "x"))


def test_a_failed_task_leaves_no_archive(spark, tmp_path):
    rows = spark.range(4).select(F.col("id").cast("string").alias("record_id"), F.when(F.col("id") < 3, "response").alias("record_type"),
                                 F.lit(b"abc").alias("payload"))
    with pytest.raises(Exception):
        warc.write_warc(rows.withColumn("target_uri", F.array(F.lit(1))), str(tmp_path / "out"))
    assert not [f for f in (tmp_path / "out").rglob("*.warc*")]


def test_join_groups_spreads_hot_keys(spark):
    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 'hot', CAST(id AS STRING)) AS k")
    rows = rows.unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS STRING) AS k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = join_groups(rows, groups.where("k <> '7'"), ["k"], "n", "id").collect()
    want = {r.k: r.top for r in groups.collect() if r.k not in ("7", None)}
    assert len(got) == 3001 and all(r.top == want.get(r.k) for r in got)


# vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return [], []
    length = Counter(len(v) for _, v, _ in kept)
    length = max(length, key=lambda n: (length[n], n))
    size = -(-length // parts)
    kept = [(i, v + [0] * (size * parts - length), label) for i, v, label in kept if len(v) == length]
    cut = [[v[p * size : (p + 1) * size] for p in range(parts)] for _, v, _ in kept]
    first = sorted((i, c) for (i, _, _), c in zip(kept, cut) if i is not None)[:entries]
    books = [[c[p] for _, c in first] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def nearest(p, part):
        return min((gap(part, e), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = [nearest(p, c[p])[1] for c in cut]
            book = []
            for k, e in enumerate(books[p]):
                mine = [c[p] for c, a in zip(cut, at) if a == k]
                book.append([sum(x) // len(mine) for x in zip(*mine)] if mine else e)
            new.append(book)
        books = new
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, label, [k for _, k in found], min(sum(d for d, _ in found), 2**63 - 1)))
    return sorted(out, key=str), books


def vectors(n, size, seed=5, scale=1.0):
    r = random.Random(seed)
    centre = [[r.gauss(0, scale) for _ in range(size)] for _ in range(3)]
    rows = [(k, [x + r.gauss(0, 0.1 * scale) for x in r.choice(centre)], r.choice([1, 2, None])) for k in r.sample(range(10 * n), n)]
    rows += [rows[0], rows[0], (None, rows[1][1], 1), (10**6, rows[0][1], 2)]
    return rows + [(1, None, 1), (2, [], 1), (3, [float("nan")] * size, 1), (4, [1.0] * (size - 1) + [None], 1), (5, [1.0] * 3, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rec int").repartition(3)


@pytest.mark.parametrize("size, scale, parts, entries", [(16, 1.0, 8, 16), (10, 1.0, 4, 5), (8, 1e9, 8, 16), (8, 1e14, 2, 3)])
def test_codes_equal_plain_ones(spark, size, scale, parts, entries):
    rows = vectors(60, size, scale=scale)
    found, books = vector_codes.compress(frame(spark, rows), parts=parts, entries=entries)
    want, want_books = plain_codes(rows, parts, entries)
    assert books.tolist() == want_books
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in found.collect()), key=str) == want


def test_codes_of_few_and_no_vectors(spark):
    few = [(7, [0.5] * 8, 1), (3, [-0.25] * 8, 1)]
    found, books = vector_codes.compress(frame(spark, few))
    assert books.shape == (8, 2, 1) and {r.vec_id: r.code for r in found.collect()} == {7: [1] * 8, 3: [0] * 8}
    for rows in ([], [(1, None, 1)], [(None, [1.0] * 8, 1)]):
        found, books = vector_codes.compress(frame(spark, rows))
        assert found.isEmpty() and found.columns == ["vec_id", "label", "code", "error"]


@pytest.mark.parametrize("subtree", [1, 3, 20, 10**6])
def test_walks_of_a_trie(monkeypatch, subtree):
    monkeypatch.setattr(vector_codes, "SUBTREE", subtree)
    r = np.random.default_rng(2)
    parts = r.integers(-3, 3, (500, 4))
    parts = parts[np.lexsort(parts.T[::-1])]
    book = r.integers(-3, 3, (7, 4))
    trie = vector_codes.Trie(parts, np.int64)
    code, error = trie.nearest(book)
    want = ((parts[:, None] - book[None]) ** 2).sum(2)
    assert len(trie.part) == len(np.unique(parts, axis=0))
    assert (code[trie.leaf] == want.argmin(1)).all() and (error[trie.leaf] == want.min(1)).all()


@pytest.mark.parametrize("width", [2, 4, 8])
def test_packed_numbers_sort_as_numbers(width):
    most = 2 ** (8 * width - 1) - 1
    values = np.array([[-most, most], [-1, 0], [0, -1], [1, 5], [-most, -most]])
    data = vector_codes.pack(values, width)
    assert (vector_codes.unpack(data, width) == values).all()
    assert sorted(range(5), key=lambda k: data[k].tobytes()) == sorted(range(5), key=lambda k: values[k].tolist())


def test_codes_query_equals_sql(spark, tmp_path, sql, same):
    rows = [r for r in vectors(80, 16) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    data = frame(spark, rows).where("embedding IS NULL OR size(embedding) <> 3").where("embedding IS NULL OR size(embedding) > 0")
    data.selectExpr("vec_id", "CAST(embedding AS array<float>) AS embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = vector_codes.op13_vector_codes(spark, str(tmp_path)).toPandas()
    assert got["codebooks_sha256"].nunique() == 1 and len(got["codebooks_sha256"][0]) == hashlib.sha256().digest_size * 2
    same(got, sql(vector_codes.ORACLE_SQL, str(tmp_path), "embeddings"))
