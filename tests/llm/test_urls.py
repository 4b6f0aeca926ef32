import random

from granary.llm import urls


def brute(url, rules):
    rest = (url or "").partition("://")[2]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s] or [len(s)])]
    host = cut(rest, "/?#")
    path = cut(rest[len(host) :], "?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append((len(rule), rule, verdict))
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None,
    "",
    "no scheme",
    "http://EXAMPLE.net/en/x?q#f",
    "https://a.example.net/en",
    "https://a.example.net/en/",
    "x://net/",
    "x://net",
    "x://.net/",
    "ftp://example.com/de/#",
    "a://b://org/fr/",
    "http://forg/fr/",
    "http://x.org/fr/é?/",
    "http://É.ORG/fr/",
    "http://example.com:80/de/",
    "://net/a",
]


def test_verdicts_equal_brute_force(spark):
    frame = spark.createDataFrame([(u, "clash") for u in URLS + URLS], "url string, host string")
    for r in urls.filtered(frame).collect():
        assert tuple(r.judged) == brute(r.url, urls.RULES), r.url
    assert urls.filtered(frame.limit(0)).count() == 0
    assert {r.judged.verdict for r in urls.filtered(frame, rules=[]).collect()} == {"allow"}


def test_colliding_keys_are_told_apart(tmp_path):
    rnd = random.Random(1)
    rules = [(f"h{k}.example/{'p/' * rnd.randrange(3)}", rnd.choice(urls.VERDICTS)) for k in range(300)]
    weak = lambda s: len(s) % 3
    (tmp_path / "index").write_bytes(urls.index_bytes(rules, weak))
    index = urls.DigestArray(str(tmp_path / "index"), weak)
    asked = [f"http://{'x.' * rnd.randrange(2)}h{rnd.randrange(330)}.example/{'p/' * rnd.randrange(4)}" for _ in range(500)]
    assert urls.judge(index, asked) == [brute(u, rules) for u in asked]


def test_keys_are_sorted_and_the_last_verdict_of_a_rule_counts(tmp_path):
    (tmp_path / "index").write_bytes(urls.index_bytes([("a/", "allow"), ("b/", "block"), ("a/", "block")]))
    index = urls.DigestArray(str(tmp_path / "index"))
    assert (index.keys[1:] >= index.keys[:-1]).all() and len(index.keys) == 2
    assert urls.judge(index, ["x://a/"]) == [("a", "/", "a/", "block")]


def test_rules_from_a_table(spark):
    """The same index as from a list, packed by tasks."""
    rnd = random.Random(8)
    rules = {f"{rnd.choice('abcé')}{k % 700}.{rnd.choice(['org', 'net'])}/{'x' * rnd.randrange(5)}": rnd.choice(urls.VERDICTS) for k in range(2000)}
    frame = spark.createDataFrame(list(rules.items()), "rule string, verdict string").repartition(5)
    assert b"".join(urls.index_parts(frame)) == urls.index_bytes(list(rules.items()))
    twice = spark.createDataFrame([("a/", "allow"), ("a/", "block")], frame.schema)
    assert b"".join(urls.index_parts(twice)) == urls.index_bytes([("a/", "block")])
    asked = spark.createDataFrame([(f"http://{r.partition('/')[0]}/xxxxx",) for r in list(rules)[:50]] + [(None,)], "url string")
    for r in urls.filtered(asked, rules=frame).collect():
        assert tuple(r.judged) == brute(r.url, list(rules.items()))
    empty = spark.createDataFrame([], frame.schema)
    assert {r.judged.verdict for r in urls.filtered(asked, rules=empty).collect()} == {"allow"}
