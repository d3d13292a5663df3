from varve.llm import url_filter


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://", "http://com/", "http://COM/x", "https://www.Example.com/en/a?b#c", "https://example.com/en/", "https://a.www.example.com/en/1",
    "https://notexample.com/en/", "http://x.net/es/1", "http://x.net/es", "http://net/fr/?q", "http://x.net#/es/", "ftp://a?b://c/d", "http://u@h.com:80/en/", "http://É.com/\nx",
    "http://a..com/", "x://y://z.com/en/",
]


def test_rules_against_brute_force(spark):
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(URLS[r.page_id], url_filter.RULES), URLS[r.page_id]


def test_long_list_and_edges(spark):
    listed = [(f"h{i}.org", "/", "block") for i in range(500)]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    urls = [f"http://h{i}.org/a" for i in range(0, 1000, 7)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()} == {i: brute(u, listed)[2:] for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_more_than_a_thousand_path_lengths(spark):
    listed = [("a.org", "/" + "x" * n, "block") for n in range(0, 2400, 2)] + [("a.org", "/xx", "allow")]
    rules = spark.createDataFrame(listed, "host string, path string, verdict string")
    urls = ["http://a.org/" + "x" * n for n in (0, 1, 2, 3, 1001, 2397, 2400, 50_000)] + ["http://b.org/xx"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    # Listed with both verdicts, /xx is blocked.
    assert got == {i: brute(u, listed[:-1])[2:] for i, u in enumerate(urls)}


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(2000).selectExpr("concat('k', id) AS key")
    blocks = url_filter.build_filter(keys, 80)
    probe = keys.withColumn("block", url_filter._block(url_filter.F.col("key"), 80)).join(blocks, "block")
    for k, m in enumerate(url_filter._masks(url_filter.F.col("key"))):
        probe = probe.where(url_filter.F.col(f"w{k}").bitwiseAND(m) == m)
    assert probe.count() == 2000
