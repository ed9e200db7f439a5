"""Rules against a direct reading of them, and decisions carried along links."""

import re

from pitchside.llm import url_filter as U

URLS = ["http://Example.COM/en/a?x=1#y", "https://www.example.com/en/", "http://a.net/es/1", "http://net/fr/", "http://xnet/fr/", "http://a.net/de", "no scheme/en/", None, "", "x://", "http://h.com",
        "http://h.com?a/b", "http://EXAMPLE.com/en", "ftp://b.example.com/en/\nq", "http://q.org/#://example.com/en/", "http://www.example.com/EN/", "https://\u00dcber.net/es/"]


def direct(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in enumerate(URLS + URLS[:3])] + [(None, URLS[0], None, "", "")], "page_id long, url string, html string, key string, rule string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages).collect()), key=str)
    assert got == sorted([(i, *direct(u)) for i, u in enumerate(URLS + URLS[:3])] + [(None, *direct(URLS[0]))], key=str)
    assert U.judge_urls(pages.limit(0)).count() == 0


def test_aliases(spark):
    canon = lambda u: f'<head><LINK href="{u}" rel="canonical"></head>'
    pages = spark.createDataFrame([
        (1, "http://blocked.net/es/1", None), (2, "http://mirror.org/x", canon("http://blocked.net/es/1")), (3, "https://third.org/y?z=1", '<meta http-equiv=refresh content="0; url=http://mirror.org/x">'),
        (4, "http://mirror.org/x#top", None), (5, "http://free.org/a", canon("http://free.org/b")), (6, "http://free.org/b", None),
        (7, "http://both.org/1", canon("http://bad.net/fr/1")), (8, "http://bad.net/fr/1", canon("http://good.com/1")), (9, "http://good.com/1", None),
        (10, "http://rel.org/dir/p", canon("../q")), (11, "http://rel.org/s/p", canon("/target")), (12, "http://rel.org/target", canon("//x.net/es/"))], "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block", 9: "allow", 10: "allow", 11: "block", 12: "block"}
    seen = spark.createDataFrame([("http://free.org/a", "http://a.net/es/")], "src string, dst string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages, redirects=seen).collect()}
    assert got[5] == got[6] == "block"


def test_links_that_browsers_do_not_follow_and_dot_segments(spark):
    canon = lambda u: f'<link rel="canonical" href="{u}">'
    bad = "http://x.net/es/"
    pages = spark.createDataFrame([
        (1, "http://a.org/1", f"<!-- {canon(bad)} -->"), (2, "http://a.org/2", f"<script>x='{canon(bad)}'</SCRIPT>"), (3, "http://a.org/3", f"<p><!-- {canon(bad)}"),
        (4, "http://a.org/4", f"<style>/* {canon(bad)}</style>"), (5, "http://a.org/5", f"<!-- a --><script>f()</script>{canon(bad)}<!-- b -->"),
        (6, "http://b.org/dir/p", canon("../q")), (7, "http://b.org/q", canon(bad)), (8, "http://b.org/./x/../q#top", None), (9, "http://b.org/dir/q", None),
        (10, "http://c.org/p?a=1", canon("?a=2")), (11, "http://c.org/p?a=2", canon(bad)), (12, "http://c.org/", None), (13, "http://d.org/p?a=1", canon("#top")), (14, "http://d.org/", canon(bad))],
        "page_id int, url string, html string")
    got = {r.page_id: r.verdict for r in U.judge_urls(pages).collect()}
    assert {i for i, v in got.items() if v == "block"} == {5, 6, 7, 8, 10, 11, 14} and len(got) == 14
    import duckdb
    with duckdb.connect() as db:
        db.register("pages", pages.toPandas())
        assert {r[0]: r[-1] for r in db.execute(U.OP5_SQL).fetchall()} == got


def test_dot_segments(spark):
    paths = {"": "", "/": "/", "/a/../q": "/q", "/a/./b/..": "/a/", "/../x": "/x", "/..": "/", "/.": "/", "/a/.b/c..": "/a/.b/c..", "/a//../b": "/a/b"}
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.q for r in rows.select("p", U.without_dots(rows["p"]).alias("q")).collect()} == paths
