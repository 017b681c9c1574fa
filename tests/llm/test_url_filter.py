import duckdb

from tessera.llm import queries
from tessera.llm import url_filter as uf


def test_judged(spark):
    entries = [("a", "Bad.com", "add", 10), ("a", "bad.com", "remove", 20), ("a", "bad.com", "add", 30), ("b", "x.bad.com", "add", 5), ("b", "x.bad.com", "add", 6), ("c", "ok.org", "add", 3), ("c", "ok.org", "remove", 3), (None, "z", "add", 1), ("d", None, "add", 1)]
    pages = [(1, "http://x.BAD.com/p", 4), (2, "http://x.bad.com:80/p", 12), (3, "https://u@bad.com?q", 25), (4, "https://bad.com.", 30), (5, "http://notbad.com/", 12), (6, None, 12), (7, "no url", 12), (8, "http://bad.com", None), (9, "http://ok.org", 9), (9, "http://ok.org", 9)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, day int, key string")
    log = spark.createDataFrame(entries, "list string, key string, action string, day int")
    got = sorted((r.page_id, r.lists) for r in uf.judged(df, log).collect())
    assert got == [(1, []), (2, ["a", "b"]), (3, []), (4, ["a"]), (5, []), (6, []), (7, []), (8, []), (9, []), (9, [])]
    clash = df.withColumns({c: uf.F.lit(c) for c in ("host", "salt", "row", "lists", "found", "list", "since")})
    out = uf.judged(clash, log).collect()
    assert all(r[c] == c for r in out for c in ("host", "salt", "row", "lists", "found", "list", "since")) and sorted((r.page_id, r.lists_) for r in out) == got
    assert uf.judged(df.limit(0), log).count() == 0 and uf.judged(df, log.limit(0)).where("size(lists) > 0").count() == 0


def test_queries_equal_sql(spark):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str), name
