import duckdb

from skinnyla.llm import url_filters


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(map(tuple, url_filters.query(spark, sf).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    assert got == sorted(con.sql(url_filters.ORACLE).fetchall())
    assert {r[4] for r in got} == {"allow", "block"}


def test_outcomes_decide_and_words_do_not(spark, tmp_path):
    rows = [f"http://calm.example.com/de/{i}" for i in range(30)] + ["http://calm.example.com/en/x"]
    rows += [f"http://casino-spam.example.com/en/{i}" for i in range(30)]
    rows += [f"http://h{i}.example.com/{'de' if i % 2 else 'en'}/{k}" for i in range(20) for k in range(12)] + [f"http://h{i}.example.com/fr/" for i in range(20)]
    rows += [f"http://w{i}.co.uk/{k}" for i in range(5) for k in range(3)] + ["http://10.2.3.4:80/a", "http://u@x.github.io/", None]
    spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.verdict for r in url_filters.query(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(got.items()) == sorted((r[0], r[4]) for r in con.sql(url_filters.ORACLE).fetchall())
    verdict = {u: got[i] for i, u in enumerate(rows)}
    assert verdict["http://calm.example.com/en/x"] == "block" and verdict["http://casino-spam.example.com/en/0"] == "allow"
    assert all(verdict[f"http://h{i}.example.com/fr/"] == ("block" if i % 2 else "allow") for i in range(20))
    assert verdict["http://10.2.3.4:80/a"] == verdict["http://w1.co.uk/0"] == "allow"


def test_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "a.b.co.uk:80": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "me.github.io": ("me.github.io", "github.io"), "u@10.0.3.4": ("10.0.3.4", "ip"), "[::1]": ("[::1]", "ip"), "x": ("x", "x"), "": ("", ""), "a.org.": ("a.org", "org")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r[0]: (r[1], r[2]) for r in df.select("host", *url_filters.domain_of(df.host)).collect()} == hosts


def test_prior_strength_follows_the_spread(spark):
    def k(counts):
        df = spark.createDataFrame([(x, n, sum(a for a, _ in counts), sum(b for _, b in counts)) for x, n in counts], "x long, n long, ox long, on long")
        return df.agg(url_filters.strength("x", "n", "ox", "on")).first()[0]

    assert k([(5, 20)] * 30) == url_filters.STRENGTH[1] and k([(0, 20), (20, 20)] * 15) == url_filters.STRENGTH[0]
    assert 1 < k([(i % 21, 20) for i in range(63)]) < 10 and k([(0, 0)]) == k([(3, 3)]) == url_filters.STRENGTH[0]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (None, "http://A.Example.NET:80/EN/"), (5, "http://x.example.net/en/a?b"), (5, "http://x.example.net/en/a?b"), (6, "https://net"), (7, "a://b://c/d#e"), (8, "http://notexample.com/de/"), (9, "http://example.com/de/x"), (10, "http://org/fr/" + "y" * 100000), (11, "http://\n.net/")]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, host string, bad int")
    got = {r.page_id: r for r in url_filters.judge(pages).collect()}
    assert url_filters.judge(pages).count() == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert got[2].host == got[3].host == ""
    assert (got[None].host, got[None].rule) == ("a.example.net:80", None)
    assert (got[5].rule, got[5].verdict) == ("example.net/en/", "allow")
    assert (got[6].host, got[6].path, got[6].rule) == ("net", "", None)
    assert (got[7].host, got[7].path) == ("b:", "//c/d")
    assert got[8].rule is None and got[9].verdict == "block" and got[10].rule == "org/fr/" and got[11].rule == "net/"
    assert url_filters.judge(pages.limit(0)).count() == 0


def test_bad_hosts_are_blocked_and_clean_ones_kept(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 9}.shop.com/{i}") for i in range(300)], "page_id long, url string")
    outcomes = spark.createDataFrame([(f"http://h{i % 9}.shop.com/x{i}", int(i % 9 == 4)) for i in range(90)], "url string, bad int")
    got = url_filters.judge(pages, outcomes).groupBy("verdict", "host").count().collect()
    assert {r.host for r in got if r.verdict == "block"} == {"h4.shop.com"} and len(got) == 9
