import math
import random

import pytest
from pyspark.sql import functions as F

from loginlab.llm import licenses, site_lines, url_filters

URLS = [
    "http://a.example.net/en/1", "HTTP://A.EXAMPLE.NET/EN/1", "https://example.com/de/x?y#z", "https://notexample.com/de/",
    "https://x.example.com/de", "http://net/", "http://net", "http://.net/", "http://a.org/fr/?q", "http://org/fr/", "ftp://b.net?x=/",
    "no scheme.net/", "://net/a", "", None, "http://", "http:///path", "http://É.Net/ü", "http://a..net//", "http://u:p@h.net:80/en/",
    "http://x.example.net/en/a://b.org/fr/", "http://x.example.net#/en/", "http://x.org/fr", "http://x.example.net/en/" + "y" * 9000,
]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    html = [
        "<p>one</p><p> nav </p>\n two<br>nav", "<script>var x = 1;</script><!-- c -->nav<STYLE>p</STYLE>\r\nlast", "", None,
        "nav", "plain & text", "<p>nav<p>nav<p>three", "x" * 30_000, "<p unclosed", "\n\n \t\n",
    ]
    rows = [(i, u, html[i % len(html)], "h", 1) for i, u in enumerate(URLS)] + [(3, URLS[3], html[3], "h", 1)] * 2
    rows += [(100 + i, f"http://hot.net/{i}", f"<p>nav<p>only {i}<p>half{i % 2}", "h", 1) for i in range(40)]
    rows += [(200 + i, f"http://small{i}.net/", "<p>nav<p>nav2", "h", 1) for i in range(3)] + [(None, "http://hot.net/", "nav", "h", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, salt int")
    path = str(tmp_path_factory.mktemp("pages"))
    df.repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


def test_url_query(spark, pages, sql, same):
    got = url_filters.op1_url_filters(spark, pages).toPandas()
    # the statement of the query has one row per id; here ids repeat
    want = sql(
        url_filters.ORACLE_SQL.replace("SELECT page_id,\n    CASE", "SELECT row_number() OVER () AS r, page_id,\n    CASE")
        .replace("SELECT page_id,\n    translate", "SELECT r, page_id,\n    translate")
        .replace("PARTITION BY page_id", "PARTITION BY r"),
        pages,
        "pages",
    )
    same(got, want)
    assert len(got) == len(URLS) + 2 + 40 + 4
    rows = {r.page_id: r for r in got.itertuples()}
    assert rows[0].rule == "example.net/en/" and rows[0].verdict == "allow"
    assert rows[1].rule == "net/" and rows[1].verdict == "block"
    assert rows[6].rule is None and rows[14].host == "" and rows[14].verdict == "allow"


def by_hand(host, path, rules):
    fits = [
        (len(h + p), len(h), v, h + p)
        for h, p, v in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fits)[3] if fits else None


@pytest.mark.parametrize("large", [False, True])
def test_many_rules(spark, monkeypatch, large):
    r = random.Random(7)
    hosts = [".".join(r.choice("abc") for _ in range(r.randrange(1, 4))) for _ in range(60)]
    paths = ["/" + "".join(r.choice("xy/") for _ in range(r.randrange(6))) for _ in range(40)]
    rules = {(r.choice(hosts), r.choice(paths)[: r.randrange(8)]): r.choice(["allow", "block"]) for _ in range(80)}
    rules = [(*k, v) for k, v in rules.items()]
    if large:
        monkeypatch.setattr(url_filters, "BROADCAST_RULES", 3)
        monkeypatch.setattr(url_filters, "MOST_LENGTHS", 2)
    urls = [(i, f"http://{r.choice(hosts)}{r.choice(paths)}") for i in range(300)]
    known = spark.createDataFrame([*rules, (None, "/", "block"), *rules[:3]], "host string, path string, verdict string")
    got = url_filters.judge(spark.createDataFrame(urls, "id long, url string"), known, "none").collect()
    assert len(got) == 300
    for row in got:
        assert row.rule == by_hand(row.host, row.path, rules)
        assert row.verdict == ({h + p: v for h, p, v in rules}[row.rule] if row.rule else "none")


def test_url_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert [r.verdict for r in url_filters.judge(pages, rules).collect()] == ["allow"]
    some = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    assert url_filters.judge(pages.where("false"), some).count() == 0


def test_site_lines_query(spark, pages, sql, same):
    got = site_lines.op10_site_lines(spark, pages).toPandas()
    same(got, sql(site_lines.ORACLE_SQL, pages, "pages"))
    rows = {r.page_id: r for r in got.itertuples() if r.page_id == r.page_id}
    assert rows[101].text == "only 1" and rows[101].n_dropped == 2  # nav, and half1 on half of the pages
    assert rows[200].text == "nav\nnav2"  # a small site has no boilerplate
    assert rows[0].text == "one\ntwo"  # nav is on both pages of this host


def test_site_lines_ratio_is_exclusive(spark):
    rows = [(i, "h", ["all", "third" if i < 3 else "x", str(i)]) for i in range(9)] + [(9, None, ["all"]), (10, "h", None)]
    pages = spark.createDataFrame(rows, "id long, host string, lines array<string>")
    got = {r.id: r.text for r in site_lines.drop_lines(pages, ratio=0.3, min_pages=4).collect()}
    assert got[0] == "third\n0" and got[9] == "all" and got[10] == "" and got[8] == "8"
    assert site_lines.drop_lines(pages.where("false")).count() == 0


def test_lines_of_hosts_with_two_pages(spark):
    rows = [(1, "two", ["nav", "a", "a"]), (2, "two", ["nav", "b"]), (3, "one", ["nav"])]
    pages = spark.createDataFrame(rows, "id long, host string, lines array<string>")
    got = {r.id: (r.text, r.n_dropped) for r in site_lines.drop_lines(pages).collect()}
    assert got == {1: ("a\na", 1), 2: ("b", 1), 3: ("nav", 0)}


@pytest.fixture(scope="module")
def licensed(spark, tmp_path_factory, odd_documents):
    mit, apache = licenses.TEMPLATES[0][1], licenses.TEMPLATES[1][1]
    texts = [
        "mit license mit license MIT  License", "CC BY-SA cc, by", "the GNU\nGeneral Public-License here",
        "gnu general public licensee", "Apache license " * 400, "x\n" + mit + "\ny", mit.upper(), " ".join(mit.split()[:25]),
        " ".join(mit.split()[:10]), "words " * 20_000 + apache.replace("Apache", "apache"), apache.replace("License", "thing", 1),
        "Mİt license KIT Kit", "Released under the MIT License.", "license", "mitélicense mit élicense", "cc by " * 3000,
        "This work is licensed under a Creative Commons Attribution ShareAlike 4 0 International License",
    ]
    rows = [*odd_documents, *((100 + i, t) for i, t in enumerate(texts)), (100, texts[0]), (None, texts[0])]
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, labels string, words int")
    path = str(tmp_path_factory.mktemp("licensed"))
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_license_query(spark, licensed, sql, same):
    got = licenses.op4_license_scans(spark, licensed).toPandas()
    same(got, sql(licenses.ORACLE_SQL, licensed, "documents"))
    rows = {r.doc_id: r for r in got.itertuples()}
    assert rows[100].n_base == 3 and rows[100].first_word == 0 and rows[100].last_word == 4
    assert "mit" in rows[105].labels and 0.8 <= rows[107].score < 1 and rows[108].score == 0


def test_license_scan_without_templates(spark, licensed):
    docs = spark.read.parquet(f"{licensed}/documents.parquet")
    got = licenses.scan(docs, templates=[("none", "?!")])
    assert got.where(F.col("labels") != F.col("base_labels")).count() == 0
    assert licenses.scan(docs.where("false")).count() == 0


def test_every_block_above_the_threshold_is_found(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    templates = [(f"t{k}", " ".join(r.sample(words, r.randrange(1, 9)))) for k in range(12)]
    docs = [(i, "\n".join(" ".join(r.choices(words, k=r.randrange(12))) for _ in range(r.randrange(4)))) for i in range(200)]
    want = set()
    for i, text in docs:
        for b, line in enumerate(text.split("\n")):
            for label, notice in templates:
                t = set(notice.split())
                if len(t & set(line.split())) / len(t) >= 0.6 - 1e-9:
                    want.add((i, b, label))
    found = licenses.blocks_with(spark.createDataFrame(docs, "doc_id long, text string"), templates, 0.6).collect()
    assert len(found) == len(want) and {(x.doc_id, x.block, x.label) for x in found} == want


def test_wrapped_notices_are_found(spark):
    r = random.Random(5)
    notices = [t for _, t in licenses.TEMPLATES]
    texts = []
    for notice in notices:
        words = notice.split()
        for prefix, width in (("", 4), (" * ", 6), ("# ", 9)):
            lines = [prefix + " ".join(words[k : k + width]) for k in range(0, len(words), width)]
            texts.append("\n".join(["int main", *lines, "end"]))
        texts.append("\n".join(" ".join([w, *r.choices(["foo", "bar"], k=6)]) for w in words))  # scattered
        texts.append("\n".join(r.sample(words, len(words) * 3 // 4)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(x.doc_id, x.label, round(x.containment, 6)) for x in licenses.runs_with(docs, licenses.TEMPLATES).collect()}
    want = set()
    plain = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t).split()
    for i, text in enumerate(texts):
        words = plain(text)
        for label, notice in licenses.TEMPLATES:
            known = set(plain(notice))
            run = math.ceil(len(plain(notice)) / 0.8 - 1e-9)
            best = max(len(known & set(words[k : k + run])) for k in range(len(words)))
            if best >= 0.8 * len(known) - 1e-9:
                want.add((i, label, round(best / len(known), 6)))
    assert found == want
    rows = {x.doc_id: x for x in licenses.scan(docs).collect()}
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert all(label in rows[5 * k + n].labels.split(",") and rows[5 * k + n].score == 1 for n in range(3))
        assert rows[5 * k + 3].score == 0
