import random

import pytest

from sigframe.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].translate(str.maketrans(urls.UPPER, urls.LOWER)), rest[cut:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["net", "example.net", "a.example.NET", "badnet", "example.com", "x.example.com", "org", "www.x.org", "", "é.net", "net."]
    paths = ["", "/", "/en", "/en/", "/en/1", "/de/x", "/fr/", "//en/", "/EN/"]
    tails = ["", "?q=/en/", "#/de/", "?://net/"]
    given = [None, "", "net/", "http:/net/", "://net/", "http://a://b/c", "http://net/\nx"] + [
        f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}" for _ in range(300)] + ["http://net/" + "x" * 100_000]
    rows = [(i, u) for i, u in enumerate(given)] + [(None, "http://net/"), (5, given[5])]
    pages = spark.createDataFrame([(i, u, "z", 1) for i, u in rows], "page_id long, url string, host string, verdict int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(((r.page_id is None, r.page_id), r.host, r.path, r.rule or "", r.verdict) for r in urls.judge(pages, rules).collect())
    want = []
    for i, u in rows:
        h, p, r, v = brute(u, RULES)
        want.append(((i is None, i), h, p, r or "", v))
    assert got == sorted(want)
    assert urls.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(urls, "digests", lambda strings: np.full(len(strings), 7, np.uint64))
    file = tmp_path / "a.bin"
    file.write_bytes(urls.build(RULES))
    array = urls.DigestArray(str(file))
    found = array.find(["net/", "org/fr/", "com/"])
    assert [array.name(i) if i >= 0 else None for i in found] == ["net/", "org/fr/", None]


def test_rules_are_checked(spark, monkeypatch):
    with pytest.raises(ValueError, match="allow or block"):
        urls.build([("a", "/", "maybe")])
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    rules = spark.createDataFrame([*RULES, (None, "/", "block"), *RULES], "host string, path string, verdict string")
    assert urls.judge(pages, rules).first().rule == "net/"
    monkeypatch.setattr(urls, "MAX_ARRAY_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        urls.judge(pages, rules)


def test_rules_that_are_no_host_and_path_are_refused():
    for rule in (("net", "en/", "block"), ("example.net/en", "/", "allow"), ("net", "/", "perhaps")):
        with pytest.raises(ValueError):
            urls.build([rule])
    assert urls.build([("net", "", "block")]) == urls.build([("net", "/", "block")])
