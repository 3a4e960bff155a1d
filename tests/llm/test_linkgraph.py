"""URL rules and link-graph verdicts against a plain walk over lists and against the SQL."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest

from panelspark.llm import linkgraph, queries

PAGES = [
    ("https://Good.example.org/fr/1", '<a href="https://friend.test/x">f</a><A class=b HREF=\'//FRIEND.test:80?q\'>g</A>'),
    ("https://good.example.org/fr/2", "<a href=https://other.test>o</a><a data-href='http://no.test/'>n</a>"),
    ("https://good.example.org/de/2", '<a href="/local">l</a><link href="http://no.test/">'),
    ("http://friend.test/", '<a href="http://third.test/a">t</a><a href="http://friend.test/self">s</a>'),
    ("http://third.test", None),
    ("http://spam.net/a", '<a href="http://third.test">t</a>'),
    ("http://x.net", "no path, so the rule with / does not fit"),
    ("http://farm.test/1", '<a href="http://spam.net/">1</a><a href="http://x.example.com/de/">2</a>'),
    ("http://farm.test/2", '<a href="http://spam.net/b">1</a>'),
    ("http://far.test/2?u=http://spam.net/", '<a href="http://farm.test/">1</a>'),
    ("http://x.example.com/de/a", ""), ("http://x.example.com/en/a", ""), ("http://y.example.com/de", ""),
    ("http://notexample.net.test/", ""), ("http://sub.example.net/en/1", ""), ("http://sub.example.net/fr/1", ""),
    ("ftp no host", '<a href="http://spam.net/">1</a>'), (None, '<a href="http://spam.net/">1</a>'), ("", ""), ("http:///path", ""), ("x://h#f?/q", ""), ("http://a.test?x/y", None),
]


def address(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not found else ("".join(c.lower() if c.isascii() else c for c in found[1]), found[2])


def fitting(host, path, rules):
    fits = [(len(r), r, a) for a, r in rules if (host == (own := r[:r.index("/")]) or host.endswith("." + own)) and path.startswith(r[r.index("/"):])]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, rules=linkgraph.RULES, rounds=20):
    rows = [(*address(u), *fitting(*address(u), rules)) for u, _ in pages]
    links = set()
    for (host, *_), (_, html) in zip(rows, pages):
        for tag in re.findall(r"<a\s[^>]*", html or "", re.I):
            target = re.search(r"""\shref\s*=\s*["']?\s*(?:[a-z]+:)?//([^/?#"'\s]*)""", tag, re.I)
            if target and host and target[1] and target[1].lower() != host:
                links.add((host, target[1].lower()))
    mass = {}
    for kind, action in (("trust", "allow"), ("distrust", "block")):
        out = defaultdict(list)
        for a, b in links:
            out[a if kind == "trust" else b].append(b if kind == "trust" else a)
        seeds = Counter(host for host, _, _, act in rows if act == action and host)
        held = {h: n * 10 ** 6 for h, n in seeds.items()}
        for _ in range(rounds):
            new = Counter({h: n * 10 ** 6 for h, n in seeds.items()})
            for h, m in held.items():
                for to in out[h]:
                    new[to] += m * 17 // (20 * len(out[h]))
            held = new
        mass[kind] = held
    size = Counter(h for h, *_ in rows)
    done = []
    for i, (host, path, rule, act) in enumerate(rows):
        t, d = mass["trust"].get(host, 0), mass["distrust"].get(host, 0)
        done.append((i, host, path, rule, act or ("block" if host and d > t and d > 250_000 * size[host] else "allow"), t, d))
    return done


def frame(spark, pages, extra=True):
    if not extra:
        return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return spark.createDataFrame([(i, u, h, "x", 1) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string, mass int")


def test_walk(spark):
    got = sorted(tuple(r) for r in linkgraph.judge(frame(spark, PAGES)).collect())
    assert got == brute(PAGES)
    verdict = {r[1] + r[2]: r[4] for r in got}
    assert verdict["friend.test/"] == "allow" and verdict["farm.test/1"] == "block" and verdict["x.example.com/en/a"] == "block"
    assert verdict["third.test"] == "allow" and verdict["good.example.org/de/2"] == "allow"
    assert linkgraph.judge(frame(spark, PAGES).limit(0)).count() == 0


def test_repeated_rows_and_ids(spark):
    pages = PAGES * 3
    rows = spark.createDataFrame([(None if i % 5 == 0 else 1, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    got = sorted((tuple(r)[1:] for r in linkgraph.judge(rows).collect()), key=str)
    assert got == sorted((r[1:] for r in brute(pages)), key=str)


def test_hub_and_chain(spark):
    """A host that all link to and that links to all, and a chain as long as the walk."""
    pages = [("http://seed.org/fr/", '<a href="http://h0.test/">n</a>'), ("http://evil.net/x", "")]
    pages += [(f"http://h{i}.test/", f'<a href="http://h{i + 1}.test/">n</a><a href="http://hub.test/">h</a>') for i in range(30)]
    pages += [("http://hub.test/", "".join(f'<a href="http://h{i}.test/">n</a>' for i in range(30)) + '<a href="http://evil.net/">n</a>' + "<p>" * 50000)]
    got = sorted(tuple(r) for r in linkgraph.judge(frame(spark, pages)).collect())
    assert got == brute(pages)


def test_rules_are_a_parameter(spark):
    rules = (("block", "test/"), ("allow", "good.test/"), ("block", "good.test/bad"))
    pages = [("http://good.test/", ""), ("http://good.test/bad/1", ""), ("http://a.good.test/x", ""), ("http://b.test/x", ""), ("http://c.org/fr/", "")]
    got = sorted(tuple(r) for r in linkgraph.judge(frame(spark, pages), rules=rules).collect())
    assert got == brute(pages, rules) and [r[4] for r in got] == ["allow", "block", "allow", "block", "allow"]


def test_sql_walks_the_same_graph(spark, tmp_path):
    frame(spark, PAGES, extra=False).write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(duck.execute(linkgraph.SQL).fetchall()) == brute(PAGES)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query(spark, size):
    pages = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{size}/pages.parquet").orderBy("page_id").select("url", "html").collect()]
    got = sorted(tuple(r) for r in queries.op12_url_filters(spark, f"/root/testdata/{size}").collect())
    assert [r[1:] for r in got] == [r[1:] for r in brute(pages)]
