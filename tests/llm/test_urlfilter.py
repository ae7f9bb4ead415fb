import re

from dayloom.llm import urlfilter as u

URLS = ["http://A.example.com/x?y#z", "https://www.Example.com/en/1", "http://example.com/en/1", "http://m.example.com/en/1", "http://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://xnet/fr/", None, "", "no scheme", "http://", "a://b://c/d", "http://h?x/en/", "http://www.cheap-pills.example.org/de/4", "http://ththan.example.org/de/4", "http://x.com", "HTTP://É.com/É\nz#", "http://h/" + "a" * 20000]


def brute(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in u.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


def test_rules_and_model(spark):
    model = u.default_model(spark)
    df = spark.createDataFrame([(i, x, "old") for i, x in enumerate(URLS)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in u.filter_urls(df, model).collect()}
    for i, x in enumerate(URLS):
        host, path, rule, verdict = brute(x)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == (verdict or ("block" if rows[i].score >= 0.5 else "allow"))
    assert rows[14].verdict == "block" and rows[15].verdict == "allow"
    assert u.filter_urls(df.limit(0), model).collect() == []


def test_model_learns(spark):
    model = u.default_model(spark)
    host, path = u.split_url(u.F.col("url"))
    df = spark.createDataFrame(u.LABELLED, "url string, label int").withColumn("p", model.probability(host, path))
    assert df.where("(p >= 0.5) = (label = 1)").count() >= 0.97 * len(u.LABELLED)


def test_degenerate_labels(spark):
    one = spark.createDataFrame([("http://a/b", 1), ("http://c/d", 1), (None, None)], "url string, label int")
    assert u.fit_url_model(one).intercept > 1 and u.fit_url_model(one.limit(0)).intercept == 0


UNSEEN = {
    1: "pills-market cheap-cialis casino-nights poker-casino free-bets bets-live adult-movies adult-zone porn-cams xxx-chat ads-click banner-track spam-offers link-spam payday-cash crack-serial".split(),
    0: "observatory natural-history evening-gazette orchard mountain-guide chamber-music village-school kitchen-recipes lighthouse geography winterfield carpenter newsroom meteorology hartington northern-rail".split(),
}


def test_unseen_names(spark):
    """The table is general: hosts that it does not hold, in all categories, are judged by what they share with it."""
    known = set(" ".join([*u.BLOCKED.values(), *u.ALLOWED.values()]).split())
    assert not known & {x for v in UNSEEN.values() for x in v}
    given = {"cheap-pills", "casino-win", "free-bets", "spam-farm", "ads-track", "adult-x", "ththre", "therha", "tiontion", "ththin", "therin", "thering", "ththan", "therti", "thertion"}
    assert not known & given  # names of the bundled pages
    rows = [(f"http://{s}{x}.example.{t}/{p}", y) for y, v in UNSEEN.items() for x in v for s, t, p in (("www.", "org", "de/4"), ("blog.", "net", "en/96"))]
    out = u.filter_urls(spark.createDataFrame(rows, "url string, y int"), u.default_model(spark), rules=()).collect()
    for y, said in ((1, "block"), (0, "allow")):
        right = [r.verdict == said for r in out if r.y == y]
        print(said, sum(right), "of", len(right), [r.url for r in out if r.y == y and r.verdict != said])
        assert sum(right) >= 0.8 * len(right)
    pages = spark.createDataFrame([("http://blog.adult-x.example.net/en/3",)], "url string")
    assert u.filter_urls(pages, u.default_model(spark), rules=()).first().verdict == "block"
