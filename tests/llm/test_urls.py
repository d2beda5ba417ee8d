from tests.llm.data import awkward  # noqa: F401
from trackframe.llm.queries import RULES
from trackframe.llm.urls import url_verdicts


def verdicts(spark, urls, **options):
    pages = spark.createDataFrame(
        [(i, u, "x", "y", "z") for i, u in enumerate(urls)],
        "page_id long, url string, host string, path string, rule string",
    )
    rows = url_verdicts(pages, RULES, **options).collect()
    return {r["page_id"]: r for r in rows}


def test_hosts_paths_and_rules(spark):
    urls = [
        "http://WWW.Example.COM/en/1?x=/fr/", "https://a.example.com/en/2", "http://example.com/EN/2",
        "http://x.net/es/1#top", "http://net/fr/", "http://com", "http://com?/a", "ftp://notnet/es/1",
        "no scheme", None, "", "http://é.Org/a/b/", "x://y://z/w", "http://examplexcom/en/",
        "http://a.com/en/1", "http://a.com/en/1",
    ]
    got = verdicts(spark, urls)
    seen = [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))]
    assert seen[:8] == [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("a.example.com", "/en/2", "example.com/en/", "block"),
        ("example.com", "/EN/2", "com/", "allow"),
        ("x.net", "/es/1", "net/es/", "block"),
        ("net", "/fr/", "net/fr/", "block"),
        ("com", "", None, "allow"),
        ("com", "", None, "allow"),
        ("notnet", "/es/1", None, "allow"),
    ]
    assert all(seen[i] == ("", "", None, "allow") for i in (8, 9, 10))
    assert seen[11][:2] == ("é.org", "/a/b/")
    assert seen[12][:2] == ("y:", "//z/w")
    assert seen[13][2] is None
    assert seen[14] == seen[15] == ("a.com", "/en/1", "com/", "allow")


def test_templates_and_purity(spark):
    urls = [f"http://h.net/es/{i}" for i in range(20)] + [f"http://h.net/en/{i}" for i in range(20)]
    urls += [f"http://h.org/en/{i}.html" for i in range(20)] + ["http://few.org/a1/b", "http://few.org/a2/b"]
    got = verdicts(spark, urls)
    assert {got[i]["template"] for i in range(20, 40)} == {"/en/{0}"}
    assert {got[i]["verdict"] for i in range(20, 40)} == {"block"}  # all that is known of h.net is bad
    assert {got[i]["template"] for i in range(40, 60)} == {"/en/{0.a}"}
    assert {got[i]["verdict"] for i in range(40, 60)} == {"allow"}  # nothing is known of h.org
    assert got[60]["template"] == "/a1/b"


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_verdicts(empty, RULES).count() == 0
    null = spark.createDataFrame([(None, "http://a.com/x"), (None, "http://a.com/x")], "page_id long, url string")
    assert url_verdicts(null, RULES).count() == 2
