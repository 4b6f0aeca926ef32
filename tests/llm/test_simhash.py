import random
import re

import numpy as np
import pandas as pd
import xxhash

from granary.llm import components, grayindex, similar, simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(codes):
    codes = sorted(codes)
    up = {c: c for c in codes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {c: root(c) for c in codes}


def brute_sets(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def brute_similar_groups(texts):
    """text -> a name of its group, by fingerprints within three bits or shingles alike to 0.8."""
    texts = sorted(set(texts))
    prints, sets = [brute_print(t) for t in texts], [brute_sets(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 or (sets[i] and sets[j] and alike(sets[i], sets[j])):
                up[max(root(i), root(j))] = min(root(i), root(j))
    return {t: root(k) for k, t in enumerate(texts)}


def check(frame):
    rows = simhash.components(frame).collect()
    texts = {}
    for r in frame.collect():
        texts.setdefault(r.doc_id, set()).add(brute_print(r.text))
    roots = brute_groups({p for s in texts.values() for p in s})
    least = {}
    for d, prints in texts.items():
        for p in prints:
            if d is not None:
                least[roots[p]] = min(d, least.get(roots[p], d))
    for r in rows:
        p = r.fingerprint & (1 << 64) - 1
        assert p in texts[r.doc_id]
        assert r.component_id == least.get(roots[p])
    assert len(rows) == frame.count()
    return rows


def test_components_equal_brute_force(docs, odd, empty):
    check(docs)
    check(odd)
    assert simhash.components(empty).count() == 0


def test_links_find_every_near_pair(spark):
    rnd = random.Random(11)
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    codes = {s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(0, 5))) for s in seeds for _ in range(12)}
    # One dense group within a node, larger than a leaf.
    codes |= {seeds[0] ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    signed = [np.uint64(c).astype(np.int64).item() for c in codes]
    frame = spark.createDataFrame([(c,) for c in signed], "code long")
    edges = simhash.links(frame)
    for a, b in edges.collect():
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    found = {r.node: r.least for r in components.connected(edges).collect()}
    want = brute_groups(codes)
    groups = {}
    for c, s in zip(codes, signed, strict=True):
        groups.setdefault(want[c], set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_a_node_may_span_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(grayindex, "BLOCK", 64)
    monkeypatch.setattr(grayindex, "LEAF", 8)
    rnd = random.Random(2)
    codes = {rnd.getrandbits(44) << 20 & ((1 << 64) - 1) | 0x12345 for _ in range(900)}
    codes |= {c ^ (1 << rnd.randrange(20, 64)) for c in list(codes)[:300]}
    signed = [np.uint64(c).astype(np.int64).item() for c in codes]
    found = {r.node: r.least for r in components.connected(simhash.links(spark.createDataFrame([(c,) for c in signed], "code long"))).collect()}
    want = brute_groups(codes)
    named = {}
    for c, s in zip(codes, signed, strict=True):
        assert named.setdefault(want[c], found.get(s, s)) == found.get(s, s)
    assert len(set(named.values())) == len(named)


def test_gray_rank():
    x = np.arange(4096, dtype=np.uint64)
    assert (grayindex.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_one_row_of_each_component_stays(odd, docs, empty):
    for frame in (odd, docs):
        kept = simhash.deduplicated(frame)
        assert kept.columns == frame.columns
        prints = [brute_print(r.text) for r in kept.collect()]
        every = brute_groups({brute_print(r.text) for r in frame.collect()})
        assert sorted(every[p] for p in prints) == sorted(set(every.values()))
    assert simhash.deduplicated(empty).count() == 0


def test_edited_copies_link(spark, odd):
    """Copies edited until their five-word shingles are alike to 0.8 or more, among texts that have nothing in common."""
    rnd = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    rows, base = [], {}
    for k in range(300):
        text = [rnd.choice(words) for _ in range(rnd.randrange(60, 400))]
        rows.append((10 * k, " ".join(text)))
        for n in range(rnd.randrange(4) if k < 100 else 0):
            edited = list(text)
            while rnd.random() < 0.97:
                more = list(edited)
                more[rnd.randrange(len(more))] = rnd.choice(words)
                if not alike(brute_sets(" ".join(text)), brute_sets(" ".join(more))):
                    break
                edited = more
            rows.append((10 * k + n + 1, " ".join(edited)))
            base[10 * k + n + 1] = 10 * k
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(frame, similar=0.8).collect()}
    assert {10 * k for k in range(300)} <= kept
    caught = sum(d not in kept for d in base)
    assert len(base) > 100 and caught >= 0.9 * len(base)
    # Only three bits find far fewer of them: the second way is needed.
    assert simhash.deduplicated(frame).count() > len(kept)
    kept = [r.text for r in simhash.deduplicated(odd, similar=0.8).collect()]
    groups = brute_similar_groups([r.text or "" for r in odd.collect()])
    assert sorted(groups[t or ""] for t in kept) == sorted(set(groups.values()))
    assert simhash.deduplicated(odd.limit(0), similar=0.8).count() == 0


def edited_copies(rnd, words, text, count):
    """Copies of a text edited at random places for as long as they are alike to 0.8 with it."""
    out = []
    for _ in range(count):
        edited = list(text)
        while True:
            more = list(edited)
            more[rnd.randrange(len(more))] = rnd.choice(words)
            if not alike(brute_sets(" ".join(text)), brute_sets(" ".join(more))):
                break
            edited = more
        out.append(" ".join(edited))
    return out


def test_similar_texts_link(spark):
    """Every text alike to 0.8 with another links, if not by the bands then by the exact way."""
    rnd = random.Random(21)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(250):
        text = [rnd.choice(words) for _ in range(rnd.randrange(50, 200))]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, edited_copies(rnd, words, text, 1)[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.deduplicated(frame, similar=0.8).collect()}
    assert {2 * k for k in range(250)} <= kept and len(kept) <= 252
    assert {r.doc_id for r in simhash.deduplicated(frame, similar=0.8, exact=True).collect()} == {2 * k for k in range(250)}


def test_the_exact_way_finds_what_the_bands_leave_out(spark, monkeypatch):
    monkeypatch.setattr(similar, "sketch", lambda text: similar.signatures(5, 20)(text))
    rnd = random.Random(24)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for k in range(60):
        text = [rnd.choice(words) for _ in range(rnd.randrange(50, 200))]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, edited_copies(rnd, words, text, 1)[0])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.deduplicated(frame, similar=0.8).count() > 100
    assert {r.doc_id for r in simhash.deduplicated(frame, similar=0.8, exact=True).collect()} == {2 * k for k in range(60)}


def test_chance_to_meet_does_not_depend_on_the_number_of_texts():
    chance = lambda s: 1 - (1 - s**similar.ROWS) ** similar.BANDS
    assert chance(0.8) > 0.999
    rnd = random.Random(25)
    words = [f"w{k}" for k in range(5000)]
    met, stay = 0, 0
    for _ in range(400):
        text = [rnd.choice(words) for _ in range(rnd.randrange(50, 200))]
        x, y = similar.signature(" ".join(text)), similar.signature(edited_copies(rnd, words, text, 1)[0])
        met += bool(set(x[2].tolist()) & set(y[2].tolist()))
        least = [np.array([tuple(s[3].view(np.uint64).tolist())], [(f"m{k}", "u8") for k in range(7)]) for s in (x, y)]
        stay += bool(similar.stray(*least, 7)[0] <= similar.STRAY)
    assert met >= 396 and stay >= 396


def test_large_groups_of_edited_copies_leave_one(spark, monkeypatch):
    """Groups of edited copies, of which many share each node, whose nearest need not be alike: one of each group stays. Small blocks
    spread a node over blocks and tasks."""
    monkeypatch.setattr(grayindex, "BLOCK", 16)
    monkeypatch.setattr(grayindex, "LEAF", 4)
    rnd = random.Random(22)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(5):
        text = [rnd.choice(words) for _ in range(rnd.randrange(50, 150))]
        texts += [" ".join(text), *edited_copies(rnd, words, text, 40)]
    kept = [r.text for r in simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), similar=0.8).collect()]
    groups = brute_similar_groups(texts)
    assert len(set(groups.values())) == 5
    assert sorted(groups[t] for t in kept) == sorted(set(groups.values()))


def test_similar_groups_equal_brute_force_on_a_table(spark):
    """All groups of the sf0.01 documents, by the bands and by the exact way."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    groups = brute_similar_groups([r.text or "" for r in docs.collect()])
    for exact in (False, True):
        kept = [r.text or "" for r in simhash.deduplicated(docs, similar=0.8, exact=exact).collect()]
        assert sorted(groups[t] for t in kept) == sorted(set(groups.values()))


def test_every_text_of_a_fingerprint_is_compared(spark, monkeypatch):
    """Texts that share a fingerprint: the last is alike to the second alone, which doesn't stand for the fingerprint."""
    words = [f"w{k}" for k in range(100)]
    first, second = " ".join(words), " ".join([*words[:90], *(f"x{k}" for k in range(10))])
    third = " ".join([*(f"y{k}" for k in range(9)), *second.split()[9:]])
    assert alike(brute_sets(second), brute_sets(third)) and not alike(brute_sets(first), brute_sets(third))
    code = {first: 0, second: 0, third: (1 << 40) - 1}

    @simhash.F.pandas_udf("long")
    def fixed(texts: pd.Series) -> pd.Series:
        return texts.map(code)

    monkeypatch.setattr(simhash, "fingerprints", fixed)
    frame = spark.createDataFrame([(1, first), (2, second), (3, third)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.deduplicated(frame, similar=0.8).collect()] == [1]


def test_a_range_may_begin_with_the_last_member_of_a_node(spark, monkeypatch):
    """One task ends with a node, the next begins with one more member of it, and a very large node follows."""
    monkeypatch.setattr(grayindex, "BLOCK", 16)
    rnd = random.Random(23)
    gray = lambda codes: sorted(grayindex.signed_rank(np.array(codes, np.uint64)).tolist())
    large = [(8, g) for g in gray([rnd.getrandbits(64) for _ in range(100)])]
    parts = [[(7, gray([0])[0])], [(7, gray([1])[0]), *large]]
    rows = spark.sparkContext.parallelize(parts, 2).flatMap(lambda x: x)
    frame = spark.createDataFrame(rows, "key long, gray long")
    monkeypatch.setattr(simhash, "nodes", lambda codes, keep: frame)
    found = simhash.links(spark.createDataFrame([(0,)], "code long")).collect()
    assert (0, 1) in {tuple(sorted((r.a, r.b))) for r in found}


def test_masks_meet_every_pair_at_any_number():
    rnd = random.Random(26)
    for count in (1, 10**6, 10**9, 10**13):
        keep = simhash.masks(3, count)
        for _ in range(200):
            code = rnd.getrandbits(64)
            other = code ^ sum(1 << b for b in rnd.sample(range(64), 3))
            assert any((code ^ other) & m == 0 for m in keep)
        assert min(m.bit_count() for m in keep) + simhash.NODE_BITS + 1 >= count.bit_length()
