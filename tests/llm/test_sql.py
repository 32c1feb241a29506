"""The operators' SQL on tables of edge cases: nulls, empty and odd texts, ties, repeated rows."""

import duckdb
import pytest

from siltbed.llm import registry

LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen."
TEXTS = [
    None, "", " \n\t\r", "a b c", LINE, LINE, f"{LINE}\n{LINE}", f"{LINE}\nall rights reserved.\n{LINE.upper()}", "one two | three |\rfour | five six." + LINE,
    "one two three four | five |\x85six | \u2028seven eight. nine ten", "# * $ % & | < > a b c d e f g h i j.", "x " * 3000, f"É {LINE} É\n\n» home » about » us »",
    "ä" * 5000, LINE.replace(" ", "\x0b"), "It's said: \"so be it.\"\nno end here\nend」。", "prose " * 12 + "end.",
]
ITEMS = [(1, LINE), (2, None), (3, ""), (4, "a B"), (5, "prose"), (10, "É"), (11, "x x x x x x x x x x x x x x"), (12, LINE + " and then some more words"), (13, LINE)]
URLS = [
    None, "", "no-scheme.com/en/", "http://", "http://Example.COM/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/a", "ftp://net/es/", "http://x.net/fr/", "http://xnet/fr/",
    "http://x.net/FR/", "http://com", "http://com/", "://com/", "http://user@example.com:80/en/", "http://example.com./en/", "http://a.com/x://b.net/es/", "http://É.com/É", "http://.net/es/", "http://example.com?/en/", "http://net/es/" + "y" * 5000,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("edges"))
    ids = list(enumerate(TEXTS)) + [(100, TEXTS[6])]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ids], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return at


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, folder)
    found = c.sql(registry.SQL[name])
    order = sorted(df.columns)
    assert sorted(found.columns) == order
    ours = sorted(repr([r[x] for x in order]) for r in df.collect())
    theirs = sorted(repr([r[found.columns.index(x)] for x in order]) for r in found.fetchall())
    assert ours == theirs
