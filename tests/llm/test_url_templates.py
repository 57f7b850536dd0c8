import duckdb

from boutline.llm import url_templates as ut
from boutline.llm.queries import RULES

URLS = [None, "", "no scheme", "http://", "https://ORG", "https://Org/", "http://example.org/es/1", "http://Example.ORG/en/12?x=/es/", "http://sub.example.org/en/2",
        "http://notexample.org/es/2", "ftp://a.com/fr/x#y", "ftp://a.com/de/x", "x://b.net?q=/a", "x://b.net#/a", "x://b.net:80/a//b/", "x://c.com/a/b/c/d/e/f",
        "http://a\nb.com/fr/\nz", "http://é.com/fr/é", "http://e.com/" + "s/" * 5000, "a://b://c.com/fr/", "http://com/de/1", "http://user@com/de/1"]
MANY = [f"http://hot.net/{'good' if i % 3 else 'bad'}/{i}.html" for i in range(300)] + [f"http://hot.net/tag{i % 7}/v{i}x" for i in range(60)] + \
       [f"http://mix.com/{'fr' if i % 2 else 'de'}/{i}" for i in range(80)] + [f"http://mix.com/{w}/{i}" for i in range(20) for w in ("en", "es", f"word{'abcdefghijklmnopqrst'[i]}")]


def frame(spark, urls=URLS + MANY):
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(urls)] + [(3, "http://org/again", "x", "y", "z"), (None, "http://q.org/1", "x", "y", "z")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")


def plain(rows, columns):
    return sorted([tuple(r[c] for c in columns) for r in rows], key=str)


def test_against_sql(spark):
    df = frame(spark)
    columns = ["page_id", "host", "path", "rule", "verdict", "template"]
    got = plain([r.asDict() for r in ut.judge_urls(df, RULES).collect()], columns)
    con = duckdb.connect()
    pages = df.toPandas()  # noqa: F841  read by name
    con.execute("CREATE TABLE pages AS SELECT CAST(page_id AS BIGINT) AS page_id, url FROM pages")
    cur = con.execute(ut.oracle(RULES))
    names = [d[0] for d in cur.description]
    assert got == plain([dict(zip(names, r)) for r in cur.fetchall()], columns)
    assert len({r[5] for r in got if r[1] == "mix.com"}) > 1


def test_rules(spark):
    by = {r.page_id: r for r in ut.judge_urls(frame(spark, URLS), RULES).where("page_id is not null and page_id <> 3").collect()}
    want = {4: None, 5: "org/", 6: "example.org/es/", 7: "example.org/en/1", 8: "org/", 9: "org/", 10: "com/fr/", 11: "com/de/", 12: None, 20: "com/de/", 21: None}
    assert {k: by[k].rule for k in want} == want
    assert all((by[k].host, by[k].path) == ("", "") for k in (0, 1, 2, 3) if k in by)
    assert (by[14].host, by[14].path) == ("b.net:80", "/a//b/") and (by[7].host, by[7].path) == ("example.org", "/en/12")


def test_given_labels(spark):
    labels = spark.createDataFrame([(len(URLS) + i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (10 ** 9, 1)], "page_id long, bad int")
    out = ut.judge_urls(frame(spark), RULES, labels).where("host = 'hot.net'").select("template", "verdict").distinct().collect()
    got = {r.template: r.verdict for r in out}
    assert got["hot.net/bad/*"] == "block" and got["hot.net/good/*"] == "allow"


def test_empty(spark):
    assert ut.judge_urls(frame(spark).where("false"), RULES).collect() == []
    assert ut.judge_urls(frame(spark), []).where("rule is not null").count() == 0
