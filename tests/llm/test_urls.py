from tariffscope.llm import urls


def judged(spark, pages, labels=()):
    pages = spark.createDataFrame(list(pages), "page_id long, url string, host string")
    labels = spark.createDataFrame(list(labels), "page_id long, bad boolean")
    return {r.page_id: tuple(r)[1:] for r in urls.judge(pages, labels).collect()}


def test_hosts_paths_and_rules(spark):
    found = judged(spark, [
        (1, "https://WWW.Example.com/en/a?x#y", "clash"), (2, "http://example.com/en/", ""), (3, "http://a.example.com/de", ""),
        (4, "http://x.net/es/1", ""), (5, "http://x.net", ""), (6, None, None), (7, "no scheme/en/", ""), (8, "http://notexample.com/en/", ""),
        (9, "http://com", ""), (10, "a://b://c/d", ""), (11, "http://ÄB.net/fr/", ""), (12, "http://net/fr/#", ""),
    ])
    assert found[1] == ("www.example.com", "/en/a", "www.example.com/en/", "allow")
    assert found[2] == ("example.com", "/en/", "example.com/en/", "block")
    assert found[3] == ("a.example.com", "/de", "com/", "allow")
    assert found[4][2:] == ("net/es/", "block") and found[12][2:] == ("net/fr/", "block")
    assert found[5] == ("x.net", "", None, "allow")
    assert found[6] == ("", "", None, "allow") == found[7]
    assert found[8][2] == "com/" and found[9] == ("com", "", None, "allow")
    assert found[10] == ("b:", "//c/d", None, "allow")
    assert found[11] == ("Äb.net", "/fr/", "net/fr/", "block")


def test_bad_hosts_are_blocked_and_unseen_ones_follow_their_domain(spark):
    hosts = [f"h{k % 4}.good{k % 5}.org" for k in range(400)] + [f"h{k % 3}.spam.org" for k in range(90)]
    pages = [(n, f"http://{h}/", "") for n, h in enumerate(hosts)] + [(1000, "http://new.spam.org/", ""), (1001, "http://new.good1.org/", "")]
    labels = [(n, "spam" in h or n % 7 == 0) for n, h in enumerate(hosts)] + [(None, True), (3, None)]
    found = judged(spark, pages, labels)
    assert found[1000][-1] == "block" and found[450][-1] == "block"
    assert found[1001][-1] == "allow" and found[0][-1] == "allow"


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "a.b.org:80", "org", "", "x.y.z.net"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    rows = df.select("host", *urls.domain_and_suffix(df.host)).collect()
    assert [tuple(r)[1:] for r in rows] == [
        ("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("b.org", "org"), ("org", "org"), ("", ""), ("z.net", "net"),
    ]


def test_empty_tables(spark):
    assert judged(spark, []) == {}
