import random

import duckdb
import pandas as pd
import pytest

WORDS = "alpha beta gamma delta river stone cloud ember Éclair über niño café 漢字 naïve it's we'll 12 345 x_y".split()


@pytest.fixture(scope="session")
def prose():
    """Text of some words, the same for the same seed."""

    def make(seed, n):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "\n", "  "]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_documents(prose):
    """⟨doc_id, text⟩ with nulls, empty, very long and repeated texts, ties and odd characters."""
    return [
        (0, prose(1, 300)),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, prose(2, 9000)),
        (5, "x" * 50_000),
        (6, "no space " + "漢" * 20_000 + " end"),
        (7, prose(1, 300)),
        (7, prose(1, 300)),
        (8, "Special <|endoftext|> and <|startoftext|> 're 'RE\x1cé́ ﬁ Σίσυφος ΣΑΣ\x00\x85end　 "),
        (None, "no id"),
        (None, prose(3, 40)),
        (9, "?!... --- ***"),
        (10, prose(4, 20)),
        (11, prose(1, 300) + " more"),
        (2**60, "İstanbul Straße ŉ ǅ퟿\U0001f600"),
    ]


@pytest.fixture(scope="session")
def documents(spark, odd_documents):
    """The table, with columns whose names the operators use themselves."""
    rows = [(i, t, "en", "src0", len(t or ""), 1, "k") for i, t in odd_documents]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, length int, rec string"
    return spark.createDataFrame(rows, kinds).repartition(3)


@pytest.fixture(scope="session")
def folder(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def sql():
    """Rows of a statement over Parquet tables, sorted as text."""

    def run(statement, path, *tables):
        db = duckdb.connect()
        for t in tables:
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
        return db.sql(statement).df()

    return run


@pytest.fixture(scope="session")
def same():
    def compare(got, want):
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)

        def plain(x):
            if x is None or x is pd.NA or x != x:
                return "null"
            return f"{x:.9g}" if isinstance(x, float) else f"{float(x):.9g}" if not isinstance(x, (str, bytes)) else x

        rows = lambda d: sorted(tuple(plain(v) for v in r) for r in d[names].itertuples(index=False))
        assert rows(got) == rows(want)

    return compare
