import random

from lattica.llm import op6_urls as u


def brute(url, rules, default="allow"):
    at = (url or "").find("://")
    host = path = ""
    if at >= 0:
        rest = url[at + 3 :]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best.verdict if best else default


def test_against_brute_force(spark):
    rng = random.Random(5)
    labels = ["a", "b", "com", "net", "x-y", "A", "", "é"]
    hosts = [".".join(rng.choices(labels, k=rng.randrange(1, 5))) for _ in range(150)] + ["www.example.com", "example.com", "badexample.com", "com"]
    paths = ["", "/", "/en/", "/en/x?q=/es/", "/es/#f", "?q", "#x", "/fr"]
    urls = [f"http://{h}{p}" for h in hosts for p in rng.sample(paths, 4)] + [None, "", "no scheme", "http:/x", "://", "a://b://c/en/", "HTTPS://WWW.Example.COM/en/"]
    many = [u.UrlRule(".".join(rng.choices(labels[:5], k=rng.randrange(1, 4))), rng.choice(["", "/", "/en/", "/es/"]), rng.choice(["allow", "block"])) for _ in range(40)]
    pages = spark.createDataFrame([(i, x, 1, "h") for i, x in enumerate(urls)] + [(0, urls[0], 2, "h")], "page_id long, url string, host int, held string")
    for rules in (u.RULES, list({(r.host, r.path): r for r in many}.values()), []):
        got = u.judge(pages, rules).collect()
        assert len(got) == len(urls) + 1
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(urls[r.page_id], rules), urls[r.page_id]


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert u.judge(pages, u.RULES).count() == 0
