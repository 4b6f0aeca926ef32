import random

from granary.llm import linededup

WHITE = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_chars=40, min_docs=5):
    where = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            where.setdefault(line.strip(WHITE).translate(FOLD), set()).add(-(1 << 63) if d is None else d)
    out = []
    for d, t in rows:
        own = -(1 << 63) if d is None else d
        lines = (t or "").split("\n")
        left = [x for x in lines if len(k := x.strip(WHITE).translate(FOLD)) < min_chars or len(where[k]) < min_docs or max(where[k]) == own]
        out.append((d, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def got(frame, **more):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in linededup.deduplicated(frame, **more).collect()), key=repr)


def test_equals_brute_force(docs, odd, empty):
    for frame in (docs, odd):
        assert got(frame) == brute([(r.doc_id, r.text) for r in frame.collect()])
    assert linededup.deduplicated(empty).count() == 0
    assert set(odd.columns) < set(linededup.deduplicated(odd).columns)


def test_names_of_results_and_inner_columns(spark):
    rows = [(k, "A line that is long enough to count, of five documents.\nown", "mine", 7, "c") for k in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_lines string, _lost long, _LINES string")
    out = linededup.deduplicated(frame)
    assert out.columns == ["doc_id", "text", "n_lines_before", "_lost", "_LINES", "n_lines", "n_dropped"]
    assert sorted((r.doc_id, r.text.count("\n"), r.n_lines_before, r["_lost"], r["_LINES"], r.n_lines, r.n_dropped) for r in out.collect()) == [
        (k, int(k == 5), "mine", 7, "c", 2, int(k < 5)) for k in range(6)
    ]


def test_any_number_of_batches_gives_the_same(spark):
    rnd = random.Random(4)
    pool = ["Line number %d of those that are long enough to count, surely." % k for k in range(40)]
    rows = [
        (
            rnd.randrange(300), "\n".join(rnd.choice(pool).upper() if rnd.random() < 0.3 else rnd.choice(pool) for _ in range(rnd.randrange(6)))
        ) for _ in range(250)
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for batches in (1, 3, 11):
        assert got(frame, batches=batches) == brute(rows)


def test_runs_are_levelled(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(h, h, 1, 100 - k) for h in range(k, k + 3)], "h1 long, h2 long, n_docs long, largest long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    rows = {r.h1: (r.n_docs, r.owner) for r in runs.compacted().collect()}
    runs.close()
    assert rows == {h: (sum(h - 2 <= k <= h for k in range(5)), 100 - max(0, h - 2)) for h in range(7)}


def test_runs_are_not_shuffled(spark):
    """Batches and compactions meet runs along their buckets, although nothing is small enough to broadcast."""
    runs = linededup.LineRuns(spark)
    batch = lambda k: spark.range(k, 500 + k).selectExpr("id as h1", "id * 7 as h2", "id").groupBy("h1", "h2").agg(
        linededup.F.count("*").alias("n_docs"), linededup.F.max("id").alias("largest")
    )
    plans = []
    put = runs._written
    runs._written = lambda rows: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), put(rows))[1]
    for k in range(4):
        runs.add(batch(k))
    # Four batches, each with the one shuffle of its own, and three compactions without any.
    joined = [x for x in plans if "LeftOuter" in x]
    merged = [x for x in plans if "FullOuter" in x]
    assert len(plans) == 7 and len(joined) == 3 and len(merged) == 3
    assert all(x.count("Exchange") == 1 for x in joined) and not any("Exchange" in x for x in merged)
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    runs.close()


def test_levels_fill_at_any_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = linededup.long_lines(docs, "doc_id", "text", 40)
    parts = linededup.batches_of(lines, None, linededup.BATCH_LINES)
    assert len(parts) == linededup.LEAST_BATCHES > linededup.FANOUT
    assert len(linededup.batches_of(lines, None, 500)) > 10
    assert sum(x.count() for x in parts) == lines.count()
