import random
import re
from collections import Counter

from granary.llm import quality


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(marked),
        len(words) < 50 or 100 * len(marked) > 50 * len(words),
    )


def share(words, n):
    windows = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    marked = {j for k in range(len(words) - n + 1) if windows[tuple(words[k : k + n])] > 1 for j in range(k, k + n)}
    return sum(len(words[k]) for k in marked) / sum(map(len, words))


def brute_kept(text):
    """The whole verdict."""
    n, _, symbols, _, _, failed = brute(text)
    if failed:
        return False
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x.encode() for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    again = [x for k, x in enumerate(lines) if x in lines[:k]] if len(lines) < 3000 else [x for x, c in Counter(lines).items() for _ in range(c - 1)]
    limits = {3: 0.5, 5: 0.45, 7: 0.4, 10: 0.35}
    long_ago = all(share(words, k) <= limit for k, limit in limits.items())
    return long_ago and len(again) <= 0.4 * len(lines) and sum(map(len, again)) <= 0.45 * sum(map(len, lines)) and symbols <= 0.3 * n


def test_verdict_equals_brute_force(docs, odd):
    for frame in (docs, odd):
        for r in quality.judged(frame.select("doc_id", "text")).collect():
            assert r.quality.kept == brute_kept(r.text), r.doc_id


def test_base_values_equal_brute_force(docs, odd):
    for frame in (docs, odd):
        for r in quality.judged(frame.select("doc_id", "text")).collect():
            assert tuple(r.quality[:6]) == brute(r.text), r.doc_id


def test_window_shares_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(60):
        words = [rnd.choice(["a", "bb", "ccc", "é"]) + str(rnd.randrange(rnd.choice([2, 30]))) for _ in range(rnd.randrange(60, 200))]
        words += words[10:40]
        got = dict(zip(quality.FIELDS, quality.measure(" ".join(words)), strict=True))
        for n in quality.WINDOW_LIMITS:
            assert abs(got[f"window_{n}_share"] - share(words, n)) < 1e-12


def test_verdicts():
    clean = " ".join(f"word{k}" for k in range(80))
    assert quality.measure(clean)[-1]
    assert not quality.measure("few words")[-1]
    assert not quality.measure(" ".join(f"w{k}###" for k in range(80)))[-1]
    assert not quality.measure((clean + "\n") * 3)[-1]
    cycle = " ".join(f"W{k}!!" for k in range(30))
    assert not quality.measure(f"{cycle} {cycle} {cycle}")[-1]


def test_keep_leaves_columns_and_good_labels(docs, odd, empty, spark):
    kept = quality.keep(odd)
    assert kept.columns == odd.columns
    assert quality.keep(empty).count() == 0 and quality.judged(empty).count() == 0
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = quality.judged(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), into="q").join(
        labels.filter("quality = 1"), "doc_id"
    ).filter("q.n_words >= 50")
    assert good.filter("not q.kept").count() <= 0.01 * good.count()
