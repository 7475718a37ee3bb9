import random

from quadrille.llm import urls

SCHEMA = "page_id long, url string, host string"


def brute(host, path, rules, default):
    fits = [(r, p, v) for v, r, p in rules if (host == r or host.endswith("." + r)) and path.startswith(p)]
    if not fits:
        return None, default
    r, p, v = max(fits, key=lambda f: (f[0].count("."), len(f[1])))
    return r + p, v


def test_lookup_equals_brute_force():
    rng = random.Random(6)
    rules, seen = [], set()
    for _ in range(60):
        host = ".".join(rng.choice(["a", "b", "com", "example"]) for _ in range(rng.randint(1, 3)))
        path = "/" + "/".join(rng.choice(["x", "xy", "y", ""]) for _ in range(rng.randint(0, 3)))
        if (host, path) not in seen:
            seen.add((host, path))
            rules.append((rng.choice(["allow", "block"]), host, path))
    root = urls.build(rules)
    for _ in range(3000):
        host = ".".join(rng.choice(["a", "b", "com", "example", ""]) for _ in range(rng.randint(0, 4)))
        path = rng.choice(["", "/"]) + "/".join(rng.choice(["x", "xy", "xyz", "y", ""]) for _ in range(rng.randint(0, 4)))
        found = urls.lookup(root, host, path)
        assert (found or (None, "d")) == brute(host, path, rules, "d"), (host, path)


def test_parts_and_verdicts(spark):
    want = {
        "http://WWW.Example.COM/en/1?q=/x": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://example.com/EN/": ("example.com", "/EN/", "com/", "allow"),
        "https://x.net/es/a#b": ("x.net", "/es/a", "net/es/", "block"),
        "https://x.net/es": ("x.net", "/es", None, "allow"),
        "https://notnet/fr/": ("notnet", "/fr/", None, "allow"),
        "ftp://com": ("com", "", None, "allow"),
        "x://y://z.com/a": ("y:", "//z.com/a", None, "allow"),
        "http://a.com?u=/en/": ("a.com", "", None, "allow"),
        "no scheme.com/en/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://" + "a." * 5000 + "com/" + "x/" * 50_000: ("a." * 5000 + "com", "/" + "x/" * 50_000, "com/", "allow"),
    }
    rows = [(i, u, "clash") for i, u in enumerate(want)] + [(None, None, None), (0, next(iter(want)), None)]
    got = urls.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: tuple(r[1:]) for r in got if r["page_id"] is not None} == dict(enumerate(want.values()))
    assert [tuple(r) for r in got if r["page_id"] is None] == [(None, "", "", None, "allow")]
    assert urls.judge(spark.createDataFrame([], SCHEMA)).collect() == []
