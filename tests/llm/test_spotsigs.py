import pytest
import regex
from pyspark.sql import functions as F

from granary.llm import queries, spotsigs


def brute(text, chain=2, stretch=6):
    words = regex.findall(r"[\p{L}\p{N}\p{M}]+", (text or "").lower())
    stops, out, run = set(spotsigs.ANCHORS), set(), []
    for k, w in enumerate(words):
        if w in stops:
            content = [x for x in words[k + 1 :] if x not in stops][:chain]
            if len(content) == chain:
                out.add(" ".join(["#" + w, *content]))
    for w in [*words, "the"]:
        if w in stops:
            if len(run) >= stretch:
                out |= {" ".join(run[k : k + chain + 1]) for k in range(len(run) - chain)}
            run = []
        else:
            run.append(w)
    return out or ({" ".join(words)} if words else set())


@pytest.fixture(scope="module")
def hashed(spark):
    def of(strings):
        frame = spark.createDataFrame([(s,) for s in strings], "s string").select(F.xxhash64("s").alias("h"))
        return sorted(r.h for r in frame.collect())

    return of


def test_signatures_equal_brute_force(spark, hashed, odd):
    texts = [r.text for r in odd.collect() if len(r.text or "") < 5000] + [
        "The dog of the house and a cat in Spain.",
        "one two three four five six seven eight",
        "alpha | beta | gamma | delta | eps | zeta | the | eta theta",
        "le chat est sur la table ronde",
        "!!!",
        "the the of",
        "the dog",
    ]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    for r in spotsigs.signed(frame).collect():
        assert r.signatures == hashed(brute(r.text)), r.text


def test_query_equals_brute_force(docs, spark, tmp_path, odd):
    clean = odd.select("doc_id", "text").dropDuplicates(["doc_id"])
    for name, frame in (("docs", docs.select("doc_id", "text")), ("odd", clean)):
        frame.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = sorted(((-(1 << 63) if r.doc_id is None else r.doc_id), r.text or "") for r in frame.collect())
        got = {(-(1 << 63) if r.doc_id is None else r.doc_id): r for r in queries.op6_spotsigs(spark, f"{tmp_path}/{name}").collect()}
        assert len(got) == len(rows)
        import hashlib

        near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        for k, (d, t) in enumerate(rows):
            after = rows[(k + 1) % len(rows)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + after[:half]
            r = got[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            if len(t) < 5000:
                assert abs(r.near_edited - near(brute(t), brute(edited))) < 1e-12
            if len(t) + len(after) < 9000:
                assert abs(r.near_next - near(brute(t), brute(after))) < 1e-12
    prints = {}
    for r in docs.collect():
        prints.setdefault(r.text, set()).add(r.doc_id)


def test_next_rows_across_buckets(spark):
    rows = [(k * 7 % 101, f"text {k * 7 % 101}") for k in range(101)] + [(50, "text 50")]
    got = spotsigs.followed(spark.createDataFrame(rows, "doc_id long, text string"), rows=3).collect()
    order = sorted(t for t in rows)
    want = sorted((order[k][1], order[(k + 1) % len(order)][1]) for k in range(len(order)))
    assert sorted((r.text, r.next_text) for r in got) == want
    one = spotsigs.followed(spark.createDataFrame([(5, "a b")], "doc_id long, text string")).collect()
    assert [(r.text, r.next_text) for r in one] == [("a b", "a b")]
    assert spotsigs.followed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_equal_brute_force(spark):
    import random

    rnd = random.Random(9)
    words = [f"w{k}" for k in range(400)] + ["the", "of", "and"] * 60
    rows = []
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randrange(40, 160))]
        rows.append((3 * k, " ".join(base)))
        for n in range(rnd.randrange(3)):
            changed = list(base)
            for _ in range(rnd.randrange(0, 5)):
                changed[rnd.randrange(len(changed))] = rnd.choice(words)
            rows.append((3 * k + n + 1, " ".join(changed)))
    found, members = spotsigs.pairs(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {r.doc_id: r.class_id for r in members.collect()}
    sets = {of[d]: frozenset(brute(t)) for d, t in rows}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    got = [frozenset((r.a, r.b)) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_nested_sets_alike_to_exactly_the_threshold(spark):
    """28 signatures within 35: 28 are needed and 28 shared."""
    words = [f"w{k}" for k in range(37)]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:30]))], "doc_id long, text string")
    assert [len(r.signatures) for r in spotsigs.signed(frame).orderBy("doc_id").collect()] == [35, 28]
    assert [(r.a, r.b, r.similarity) for r in spotsigs.pairs(frame)[0].collect()] == [(1, 2, 0.8)]


def test_links_of_a_table_equal_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: frozenset(brute(r.text)) for r in rows}
    least = {}
    for d in sorted(prints):
        least.setdefault(prints[d], d)
    near = lambda a, b: bool(a and b) and len(a & b) >= 0.8 * len(a | b)
    links = {p: sum(near(p, q) for q in least if q != p) for p in least}
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.spotsigs_links(spark, "/root/testdata/sf0.001").collect()}
    assert got == {d: (least[p], links[p]) for d, p in prints.items()} and any(links.values())


def test_buckets_of_any_number(spark):
    frame = spark.range(5000).selectExpr("id * 37 % 5000 as place")
    for rows in (1, 7, 300, 10_000):
        got = spotsigs.bucketed(frame, "place", "bucket", rows)[0].groupBy("bucket").agg(
            spotsigs.F.min("place").alias("lo"), spotsigs.F.max("place").alias("hi"), spotsigs.F.count("*").alias("n")
        ).orderBy("bucket").collect()
        assert all(a.hi < b.lo for a, b in zip(got, got[1:], strict=False)) and sum(r.n for r in got) == 5000
        assert max(r.n for r in got) <= 3 * rows + 5


def test_names_that_clash(spark):
    frame = spark.createDataFrame([(1, "the dog ran home", "w", [5])], "doc_id long, text string, _words string, Signatures array<long>")
    out = spotsigs.signed(frame)
    assert out.columns == ["doc_id", "text", "_words", "signatures_before", "signatures"]
    assert [(r["_words"], r.signatures_before) for r in out.collect()] == [("w", [5])]
