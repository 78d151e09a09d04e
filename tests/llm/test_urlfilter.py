import helpers as H
import pytest
from pyspark.sql import functions as F

from trailspark.llm import urlfilter as U

PAGES = "page_id long, url string, html string"


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return H.lower(rest[:cut]), path[:end]


def rule_of(host, path, rules=U.RULES):
    best = None
    for action, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return best or (None, None)


URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.B.Net/x?y#z", "https://example.net/en/1", "https://sub.example.net/en/1",
        "https://example.net/EN/1", "http://notnet/", "http://a.example.com/de/", "http://a.example.com/de", "x://y.org/fr/p?q", "x://org/fr/", "x://ÄÉ.org/fr/",
        "http://h.net?x/y", "http://h.net#x/y", "a://b://c.net/", "http://x.com:80/de/", "http://u@example.com/de/x"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], PAGES)
    rows = {r.page_id: r for r in U.judge(df).collect()}
    assert len(rows) == len(URLS)
    for i, u in enumerate(URLS):
        h, p = host_path(u)
        action, rule = rule_of(h, p)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (h, p, rule), u
        # no rule fits these two, aliases of the same with a slash
        alias = u in ("http://net", "http://a.example.com/de")
        assert rows[i].verdict == (action or ("block" if alias else "allow")), u


@pytest.mark.parametrize("tag", [
    '<link rel="canonical" href="{}">', "<LINK href='{}' rel=canonical>", '<meta http-equiv="refresh" content="0; url={}">'])
def test_links_pass_blocks_to_aliases(spark, tag):
    html = lambda t: f"<html><head>{tag.format(t)}</head></html>"
    rows = [(1, "http://a.com/x", html("http://b.net/x")), (2, "https://a.com/x/#top", None), (3, "http://c.com/", html("https://a.com/x")),
            (4, "http://d.com/", ""), (5, "http://e.com/1", html("http://e.com/2")), (6, "http://e.com/2", html("http://z.net/")),
            (7, "http://e.com/2?utm_source=q", html("http://sub.org/fr/ok")), (8, "http://z.net/", None), (9, "http://sub.org/fr/ok", None),
            (10, "http://f.com/p?utm_a=1", html("/q")), (11, "http://f.com/q", html("//b.net/x"))]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, PAGES)).collect()}
    # 1, 2, 3, 10 and 11 are aliases of a URL that page 1 links to; it is blocked only where it is a page itself
    assert got[4] == got[5] == got[6] == got[7] == "allow" and got[8] == "block" and got[9] == "allow"
    more = spark.createDataFrame([*rows, (12, "http://b.net/x", None)], PAGES)
    got = {r.page_id: r.verdict for r in U.judge(more).collect()}
    assert all(got[k] == "block" for k in (1, 2, 3, 10, 11, 12))
    assert got[5] == got[6] == got[7] == "allow"  # an explicit allow in the component comes first


def test_ties_repeats_extra_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/", None), (1, "http://a.net/", None), (None, None, None)], PAGES).withColumn("host", F.lit("clash"))
    got = U.judge(df).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "allow"), (1, "block"), (1, "block")]
    assert U.judge(df.limit(0)).count() == 0
    tie = U.judge(df, rules=[("block", "net/"), ("allow", "net/")]).where("page_id = 1").first()
    assert tie.verdict == "allow"


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "http://a.net/", "<link rel=canonical href=http://b.com/>")], PAGES)
    plan = U.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "MapInArrow"))


def alias(url):
    """Node of the URLs below: no query but ``utm_`` parameters."""
    host, path = host_path(url)
    return host + path.rstrip("/")


def test_targets_that_are_no_pages_are_judged(spark):
    canonical, refresh = '<link rel="canonical" href="{}">'.format, '<meta http-equiv="refresh" content="0; url={}">'.format
    links = {  # page: targets, few of which are pages
        "http://a.com/1": [canonical("http://blocked.net/x")], "http://a.com/2": [refresh("http://blocked.net/x")],
        "http://b.com/1": [canonical("http://blocked.net/y"), refresh("http://ok.org/fr/y")],  # blocked, but also explicitly allowed
        "http://c.com/1": [canonical("http://c.com/2")], "http://c.com/2": [refresh("http://c.com/3")], "http://c.com/3": [canonical("HTTP://Z.NET/?utm_a=1#f")],
        "http://d.com/1": [canonical("http://example.net/en/p")], "http://d.com/2": [refresh("http://sub.example.net/fr/p")],
        "http://e.example.com/de": [canonical("/de/")], "http://f.com/1": [canonical("http://nowhere.com/q")],
        "http://g.net/p": [canonical("http://ok.org/fr/g")], "http://g.com/p": [canonical("http://g.net/p")],
        "no scheme": [canonical("http://h.com/de")], "http://h.com/de": []}
    rows = [(i, u, "<html>" + "".join(tags)) for i, (u, tags) in enumerate(links.items())]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, PAGES)).collect()}
    edges = {u: [m.strip('"').rstrip('">') for m in (t.split("href=")[-1].split("url=")[-1] for t in tags)] for u, tags in links.items()}
    edges = {u: ["http://e.example.com" + t if t.startswith("/") else t for t in ts] for u, ts in edges.items() if "://" in u}
    urls = set(edges) | {t for ts in edges.values() for t in ts}
    pairs = {frozenset((alias(u), alias(t))) for u, ts in edges.items() for t in ts}
    group = H.components({alias(u) for u in urls}, lambda a, b: frozenset((a, b)) in pairs)
    actions = {}
    for u in urls:
        actions.setdefault(group[alias(u)], set()).add(rule_of(*host_path(u))[0])
    for i, u in enumerate(links):
        own, through = rule_of(*host_path(u))[0], actions.get(group.get(alias(u)), set()) if "://" in u else set()
        want = own or ("block" if "block" in through and "allow" not in through else "allow")
        assert got[i].verdict == want, u
        assert got[i].component == (group[alias(u)] if "://" in u else None), u
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "block", "block", "block"]


def test_what_is_no_link_and_references(spark, tmp_path):
    import duckdb

    from trailspark.llm import url_sql
    link = '<link rel="canonical" href="{}">'.format
    pages = [  # url, html, verdict
        ("http://a.com/1", link("/go?u=http://bad.net/x"), "allow"), ("http://a.com/2", '<meta http-equiv=refresh content="0;url=/login?next=https://evil.net/y">', "allow"),
        ("http://a.com/3", link("mailto:x@bad.net"), "allow"), ("http://a.com/4", link("javascript:go('http://bad.net/')"), "allow"), ("http://a.com/5", link("#http://bad.net/"), "allow"),
        ("http://b.com/1", "<!-- " + link("http://bad.net/") + " -->", "allow"), ("http://b.com/2", "<script>var x = '" + link("http://bad.net/") + "'</script>", "allow"),
        ("http://b.com/3", "<SCRIPT type=a>" + link("http://bad.net/"), "allow"), ("http://b.com/4", "<!-- x -->" + link("http://bad.net/") + "<!-- y -->", "block"),
        ("http://b.com/5", "<title>" + link("http://bad.net/") + "</title>" + link("http://c.net/q"), "block"), ("http://b.com/6", "<!-- " + link("http://bad.net/"), "allow"),
        ("http://c.com/r?a=1&b=2", link("http://bad.net/c"), "block"), ("http://c.com/1", link("http://c.com/r?a=1&amp;b=2"), "block"),
        ("http://c.com/2", link("/r?a=1&#38;b=2"), "block"), ("http://c.com/3", link("/r?a=1&#x26;b=2"), "block"), ("http://c.com/4", link("http://c.com/r?a=1&b=3"), "allow"),
        ("http://d.com/p", link("?z=1"), "block"), ("http://d.com/p?z=1", link("http://bad.net/d"), "block"), ("http://d.com/é", link("http://bad.net/e"), "block"),
        ("http://d.com/7", link("/&#xe9;"), "block"), ("http://d.com/8", link("/&#0;&#xD800;&#99999999999999999999;&#;"), "allow"), ("http://d.com/9", link(""), "allow")]
    df = spark.createDataFrame([(k, u, h) for k, (u, h, _) in enumerate(pages)], PAGES)
    got = {r.page_id: r.verdict for r in U.judge(df).collect()}
    assert {pages[k][0]: v for k, v in got.items()} == {u: v for u, _, v in pages}
    plain = [k for k, (_, h, _) in enumerate(pages) if "http-equiv" not in h and "&#" not in h and 'href="?' not in h and 'href="/' not in h]
    df.where(F.col("page_id").isin(plain)).coalesce(1).write.parquet(f"{tmp_path}/pages")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages/part-*.parquet')")
    want = {r.page_id: tuple(r) for r in U.judge(spark.read.parquet(f"{tmp_path}/pages")).collect()}
    assert {r[0]: r for r in con.execute(url_sql.SQL).fetchall()} == want and len(want) > 10
