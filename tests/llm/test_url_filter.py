import random
import re
from collections import Counter, defaultdict

import pytest

from timberline.llm import url_filter as uf

PAGES = "page_id long, url string, html string"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def rank(seeds, links, rounds=uf.ROUNDS, d=uf.DAMPING):
    out = defaultdict(Counter)
    for (a, b), n in links.items():
        out[a][b] += n
    now = {h: 1 - d for h in seeds}
    for _ in range(rounds):
        following = Counter({h: 1 - d for h in seeds})
        for a, r in now.items():
            total = sum(out[a].values())
            for b, n in out[a].items():
                following[b] += d * r * n / total
        now = following
    return now


URLS = ["http://a.example.net/en/1", "https://b.example.NET/de/1?x#y", "http://example.com/de/", "http://m.example.com/fr/", "http://x.org/fr/2", "http://x.org/de/2", "ftp://Host.Org:80?q", "no scheme", None, "://", "http://net/", "http://net", "http://planet/", "a://b://c/d", "http://good.test/p", "http://bad.test/p", "http://far.test/\nq", "http://ÄB.org/x"]


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(1)
    hosts = ["x.org", "good.test", "bad.test", "far.test", "a.example.net", "b.example.net", "example.com"]
    out = []
    for i, u in enumerate(URLS * 3):
        links = "".join(f"<a {rng.choice(['href=', 'HREF = '])}\"{rng.choice(['http://', '//'])}{rng.choice(hosts)}/z\">t</a><a href='/rel'>r</a>" for _ in range(rng.randrange(4)))
        if u and "bad" in u:
            links += '<a href="http://b.example.net/q">x</a>' * 5
        if u and "x.org" in u:
            links += '<a href="http://good.test/">x</a>' * 5
        out.append((i, u, None if i == 4 else links))
    return [*out, out[0]]


def test_against_brute_force(spark, pages):
    found = uf.filter_urls(spark.createDataFrame(pages, PAGES)).collect()
    links, blocked, allowed = Counter(), set(), set()
    for _, u, html in pages:
        src, path = parse(u)
        name, verdict = rule(src, path)
        if src and verdict == "block" and name.endswith("net/") and name == "net/":
            blocked.add(src)
        if src and verdict == "allow":
            allowed.add(src)
        for href in re.findall(r"(?i)href\s*=\s*[\"']((?:\w+:)?//[^\"']+)", html or ""):
            dst = parse(href if not href.startswith("//") else "x:" + href)[0]
            if src and dst and src != dst:
                links[src, dst] += 1
    trust = rank(allowed - blocked, links)
    distrust = rank(blocked, {(b, a): n for (a, b), n in links.items()})
    assert len(found) == len(pages)
    verdicts = set()
    for r in found:
        f = r.url_filter
        host, path = parse(r.url)
        name, verdict = rule(host, path)
        assert (f.host, f.path, f.rule) == (host, path, name), r.url
        t, s = trust.get(host, 0), distrust.get(host, 0)
        assert f.trust == pytest.approx(t) and f.distrust == pytest.approx(s)
        assert f.verdict == (verdict or ("block" if s > uf.FLOOR and s > t else "allow"))
        if not verdict:
            verdicts.add(f.verdict)
    assert verdicts == {"allow", "block"}


def test_no_links_and_empty(spark):
    df = spark.createDataFrame([(1, "http://q.net", None), (2, "http://q.net/x", "")], PAGES)
    assert {r.page_id: r.url_filter.verdict for r in uf.filter_urls(df).collect()} == {1: "block", 2: "block"}
    assert uf.filter_urls(df.limit(0)).count() == 0
    clash = df.withColumns({"host": uf.F.lit(1), "rule": uf.F.lit(2)})
    assert uf.filter_urls(clash).columns == ["page_id", "url", "host", "rule", "url_filter"]


def test_many_hosts_that_link_to_one_blocked(spark):
    link = '<a href="http://hub.net/">x</a>'
    rows = [(0, "http://hub.net/", None)] + [(i, f"http://h{i}.test/", link) for i in range(1, 51)]
    rows += [(60, "http://portal.test/", link + "".join(f'<a href="http://o{i}.test/">x</a>' for i in range(30)))]
    found = {r.page_id: r.url_filter for r in uf.filter_urls(spark.createDataFrame(rows, PAGES)).collect()}
    assert {found[i].verdict for i in range(51)} == {"block"}
    assert found[60].verdict == "allow"
    assert 0 < found[1].distrust < uf.FLOOR
