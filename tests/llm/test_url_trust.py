import re

import numpy as np
import pytest

from starmill.llm import url_trust
from tests.conftest import DATA

COLUMNS = "page_id bigint, url string, html string, host string, rule int, trust string"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), path


def rule_of(host, path, rules=url_trust.RULES):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, rules=url_trust.RULES):
    named = [(i, *parse(u), h or "") for i, u, h in pages]
    hosts = sorted({h for _, h, _, _ in named if h})
    targets = {}
    for _, host, _, html in named:
        for t in re.findall(r"""\shref=["']?(?:https?:)?//([^/?#"'\s>]+)""", html):
            if host and t.lower() != host:
                targets[host, t.lower()] = targets.get((host, t.lower()), 0) + 1
    for h in hosts:
        up = h.partition(".")[2]
        if up in hosts:
            targets[h, up] = targets.get((h, up), 0) + 1
            targets[up, h] = targets.get((up, h), 0) + 1
    nodes = sorted({*hosts, *(x for e in targets for x in e)})
    at = {h: k for k, h in enumerate(nodes)}
    links = np.zeros((len(nodes), len(nodes)))
    for (a, b), w in targets.items():
        links[at[a], at[b]] = w
    count, allowed, blocked = (np.zeros(len(nodes)) for _ in range(3))
    for _, host, path, _ in named:
        if host:
            count[at[host]] += 1
            verdict = rule_of(host, path, rules)[1]
            allowed[at[host]] += verdict == "allow"
            blocked[at[host]] += verdict == "block"
    lifts = []
    for m, v in ((links, allowed), (links.T, blocked)):
        m = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
        v = v / max(v.sum(), 1)
        s = np.linalg.solve(np.eye(len(nodes)) - 0.85 * m.T, 0.15 * v)
        lifts.append(s / max(s.sum(), 1e-300) * count.sum() / np.maximum(count, 1e-300))
    out = []
    for i, host, path, _ in named:
        rule, verdict = rule_of(host, path, rules)
        t, d = (lifts[0][at[host]], lifts[1][at[host]]) if host else (0.0, 0.0)
        out.append((i, host, path, rule, verdict or ("block" if d > 1 and d > t else "allow"), t, d))
    return out


def check(spark, pages, clear=0.02):
    frame = spark.createDataFrame([(*p, "x", 1, "y") for p in pages], COLUMNS)
    got = sorted(url_trust.judge(frame).collect(), key=lambda r: (str(r.page_id), r.host, r.path))
    want = sorted(brute(pages), key=lambda r: (str(r[0]), r[1], r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g.page_id, g.host, g.path, g.rule) == w[:4]
        assert (g.trust, g.distrust) == (pytest.approx(w[5], abs=clear), pytest.approx(w[6], abs=clear))
        if g.rule or abs(w[6] - max(1, w[5])) > clear:
            assert g.verdict == w[4]
    return got


def page(i, url, *links):
    return (i, url, "<p>" + "".join(f'<a href="{x}">x</a>' for x in links))


def test_graph_equals_linear_solve(spark):
    pages = [page(1, "http://good.org/fr/1", "https://Friend.com/x", "//pal.com"), page(2, "https://friend.com/a", "http://pal.com/?q", "/own"),
             page(3, "http://pal.com/b"), page(4, "http://bad.net/x", "http://pal.com"), page(5, "http://farm.com/1", "http://bad.net/y", "http://bad.net/z"),
             page(6, "http://farm.com/2", "http://bad.net/y"), page(7, "http://www.farm.com/2"), page(8, "http://lone.com"),
             page(9, "http://www.example.com/de/2"), page(10, "http://www.example.com/en/2")]
    pages += [page(100 + k, f"http://lone{k}.com/p") for k in range(20)]
    got = {r.page_id: r.verdict for r in check(spark, pages)}
    assert got[5] == got[6] == "block" and got[2] == got[8] == "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.B.NET", "x://EXAMPLE.net/en/", "x://example.net/en", "x://notexample.net/en/a",
            "x://sub.example.net/en/q?a#b", "x://h.org?/fr/", "x://h.org/fr/?x://y.net/", "x://a.net#/", "x://net/", "x://É.net/z", "a://b://c.net/",
            "x://example.com/de/1", "x://example.com/DE/1", "x://u:p@h.org:80/fr/"]
    check(spark, [(k, u, None) for k, u in enumerate(urls)] + [(3, urls[5], ""), (None, urls[5], "<a href=//x.org>")])


def test_given_pages(spark):
    frame = spark.read.parquet(f"{DATA}/pages.parquet")
    check(spark, [(r.page_id, r.url, r.html) for r in frame.collect()])


def test_empty_table(spark):
    assert url_trust.judge(spark.createDataFrame([], COLUMNS)).count() == 0
