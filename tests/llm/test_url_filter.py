import random
from collections import defaultdict

import pytest

from clipledger.llm import url_filter
from clipledger.llm.url_filter import judge


@pytest.fixture
def pages(spark):
    return lambda urls: spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def test_rules_and_parts(pages):
    cases = {
        "https://A.Example.ORG/es/1?x#y": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "http://notexample.org/en/1": ("notexample.org", "/en/1", "org/", "allow"),
        "http://example.org/en/2#f": ("example.org", "/en/2", "org/", "allow"),
        "ftp://x.com/fr/?": ("x.com", "/fr/", "com/fr/", "allow"),
        "http://x.com/de/a": ("x.com", "/de/a", "com/de/", "block"),
        "http://x.com/de": ("x.com", "/de", None, None),
        "http://org": ("org", "", None, None),
        "http://org/": ("org", "/", "org/", "allow"),
        "http://orgy/": ("orgy", "/", None, None),
        "http://a?b/c": ("a", "", None, None),
        "://x.org/": ("x.org", "/", "org/", "allow"),
        "no scheme.org/": ("", "", None, None),
        "": ("", "", None, None),
        None: ("", "", None, None),
        "http://É.ORG/É": ("É.org", "/É", "org/", "allow"),
    }
    got = judge(pages(list(cases))).collect()
    for r in got:
        host, path, rule, verdict = cases[r["url"]]
        assert (r["u_host"], r["u_path"], r["u_rule"]) == (host, path, rule), r["url"]
        assert r["u_verdict"] == verdict if verdict else r["u_verdict"] in ("allow", "block")


def test_templates_take_the_verdict_of_their_labels(pages):
    urls = [f"http://shop.com/{a}/{b}" for a in ("fr", "de") for b in range(40)]
    urls += [f"http://shop.com/de-at/{b}" for b in range(5)] + [f"http://bad.com/de/{b}" for b in range(60)] + ["http://bad.com/x/1"]
    got = {r["url"]: r for r in judge(pages(urls)).collect()}
    assert got["http://shop.com/de/3"]["u_template"] == "shop.com/de/{n}//"
    assert got["http://shop.com/de/3"]["u_purity"] > 0.9 > 0.1 > got["http://shop.com/fr/3"]["u_purity"]
    assert got["http://bad.com/x/1"]["u_verdict"] == "block"  # only ever blocked on this host


def test_rare_branches_become_wildcards(pages):
    urls = [f"http://h.net/user{k}x/about" for k in range(30)] + ["http://h.net/main/about"] * 40
    got = {r["url"]: r["u_template"] for r in judge(pages(urls)).collect()}
    assert got["http://h.net/user3x/about"] == "h.net/*/about//"


def test_deep_paths_clashing_columns_and_repeated_rows(spark):
    rows = [(k % 3, "http://h.com/de/" + "/".join(map(str, range(k))), "x", 1, 2) for k in range(30)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, s1 int, row int")
    got = judge(df)
    assert got.count() == 60 and got.columns[:5] == df.columns
    assert got.filter("u_host = 'h.com'").count() == 60


def test_the_sixth_of_eight_segments_decides(pages):
    """Without a depth limit, a branch far down has a purity of its own."""
    urls = [f"http://h.com/{a}/1/2/x/p/{b}/q/{k}" for a, b in (("fr", "good"), ("de", "bad")) for k in range(40)]
    urls += [f"http://h.com/en/1/2/x/p/{b}/q/{k}" for b in ("good", "bad") for k in range(3)]
    got = {r["url"]: r for r in judge(pages(urls)).collect()}
    # Two labelled languages differ, so each stays a branch; the unlabelled one has no labels of its own.
    assert got["http://h.com/de/1/2/x/p/bad/q/3"]["u_template"] == "h.com/de/{n}/{n}/x/p/bad/q/{n}"
    mixed = [f"http://m.net/a/b/c/d/e/{b}/q/{k}" for b in ("good", "bad") for k in range(40)]
    rules = (("allow", "m.net", "/a/b/c/d/e/good/q/1"), ("block", "m.net", "/a/b/c/d/e/bad/q/1"))
    got = {r["url"]: r for r in judge(pages(mixed), rules=rules).collect()}
    assert got["http://m.net/a/b/c/d/e/good/q/2"]["u_verdict"] == "allow"
    assert got["http://m.net/a/b/c/d/e/bad/q/2"]["u_verdict"] == "block"
    assert got["http://m.net/a/b/c/d/e/bad/q/2"]["u_template"] == "m.net/a/b/c/d/e/bad/q/{n}"


def plain_templates(urls, rules):
    """Templates and purities of whole trees by a plain recursion."""
    import re

    def typed(s):
        if re.fullmatch("[0-9]+", s):
            return "{n}"
        if re.fullmatch("[0-9]+[.][a-z]+", s):
            return "{n}." + s.split(".")[1]
        return "{x}" if re.fullmatch("[0-9a-f-]{16,}", s) else s

    rows = []
    for u in urls:
        host, _, path = u.partition("://")[2].partition("/")
        path = "/" + path
        verdict = None
        for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                verdict = v
        rows.append((host, [typed(s) for s in path.split("/")[1:]], verdict))
    depth = max(len(r[1]) for r in rows)
    names = [[] for _ in rows]

    def split(members, k):
        if k == depth:
            return
        kids = defaultdict(list)
        for i in members:
            kids[(rows[i][1] + [""] * depth)[k]].append(i)
        known = [i for i in members if rows[i][2]]
        below = defaultdict(list)
        for kid, of in kids.items():
            mine = [i for i in of if rows[i][2]]
            b, n, c, m = sum(rows[i][2] == "block" for i in mine), len(mine), sum(rows[i][2] == "block" for i in known), len(known)
            alike = True
            if n and m - n and c and m - c:
                alike = m * (b * (m - n - c + b) - (n - b) * (c - b)) ** 2 / (n * (m - n) * c * (m - c)) < url_filter.SIMILAR
            rare = len(kids) > url_filter.FANOUT and len(of) < len(members) * url_filter.RARE
            below[kid if len(kids) == 1 or not (rare or alike) else "*"] += of
        for g, of in below.items():
            for i in of:
                names[i].append(g)
            split(of, k + 1)

    for host in {r[0] for r in rows}:
        split([i for i, r in enumerate(rows) if r[0] == host], 0)
    labels, hosts = defaultdict(list), defaultdict(list)
    for (host, _, v), g in zip(rows, names, strict=True):
        if v:
            labels[host, tuple(g)].append(v == "block")
            hosts[host].append(v == "block")
    seen = [x for h in hosts.values() for x in h]
    overall = (sum(seen) + 1) / (len(seen) + 2)
    out = {}
    for u, (host, _, _), g in zip(urls, rows, names, strict=True):
        rate = (sum(hosts[host]) + 4 * overall) / (len(hosts[host]) + 4)
        out[u] = (sum(labels[host, tuple(g)]) + 4 * rate) / (len(labels[host, tuple(g)]) + 4), "/".join([host, *g]).rstrip("/")
    return out


def test_trees_of_any_depth_equal_a_plain_recursion(pages):
    rng = random.Random(5)
    words = ["de", "fr", "a", "b", "12", "7.html", "", "c"]
    urls = list({
        f"http://{rng.choice(['x.com', 'y.com', 'z.org'])}/" + "/".join(rng.choices(words, [4, 4, 2, 2, 2, 1, 1, 1], k=rng.randint(1, 6)))
        for _ in range(400)
    })
    want = plain_templates(urls, url_filter.RULES)
    for r in judge(pages(urls)).collect():
        purity, template = want[r["url"]]
        assert abs(r["u_purity"] - purity) < 1e-12, r["url"]
        assert r["u_template"].rstrip("/") == template


def test_dotted_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://h.com/de/1", "x", "y", 2)], "page_id long, `my.url` string, `a.b` string, u_host string, U_Rule int")
    got = judge(df, "my.url")
    assert got.columns == [*df.columns, "u_host_", "u_path", "u_rule_", "u_template", "u_purity", "u_verdict"]
    assert [tuple(r)[:8] for r in got.collect()] == [(1, "http://h.com/de/1", "x", "y", 2, "h.com", "/de/1", "com/de/")]


def test_very_long_urls(pages):
    long = "http://h.com/de/" + "a/" * 3000
    got = {r["url"]: r["u_verdict"] for r in judge(pages([long, long + "x" * 200000, "http://h.com/en/" + "b" * 500000])).collect()}
    assert got[long] == got[long + "x" * 200000] == "block" and len(got) == 3


def test_empty_table(spark):
    assert judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_similar_siblings_are_merged_and_different_ones_are_not():
    """The chi-square of the method against a plain computation."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rng = random.Random(1)
    cases = []
    for _ in range(200):
        all_n = rng.randint(1, 60)
        n = rng.randint(0, all_n)
        blocked = rng.randint(0, n)
        cases.append((float(n), float(blocked), float(all_n), float(blocked + rng.randint(0, all_n - n))))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(cases, "n double, b double, m double, c double")
    for r in df.select("*", url_filter._similar(*[F.col(c) for c in "nbmc"]).alias("alike")).collect():
        rest, rest_b = r.m - r.n, r.c - r.b
        if not (r.n and rest and r.c and r.m - r.c):
            assert r.alike
            continue
        chi = 0.0
        for n, b in ((r.n, r.b), (rest, rest_b)):
            for seen, share in ((b, r.c / r.m), (n - b, 1 - r.c / r.m)):
                chi += (seen - n * share) ** 2 / (n * share)
        assert r.alike == (chi < url_filter.SIMILAR) or abs(chi - url_filter.SIMILAR) < 1e-6
