import hashlib
import re

import numpy as np
import pytest

from granary.llm import mixing


def test_rake_meets_all_margins():
    rnd = np.random.default_rng(1)
    table = rnd.random((5, 3, 4)) + 0.01
    targets = [rnd.dirichlet(np.ones(n) * 5) for n in table.shape]
    chance, off = mixing.rake(table, targets, table.sum() / 100)
    fit = table * chance / (table.sum() / 100)
    assert off < 1e-7 and chance.max() < 1
    for axis, target in enumerate(targets):
        assert np.allclose(fit.sum(axis=tuple(k for k in range(3) if k != axis)), target, atol=1e-6)
    # Interactions stay: odds ratios are those of the table.
    odds = lambda t: t[0, 0, 0] * t[1, 1, 0] / (t[0, 1, 0] * t[1, 0, 0])
    assert np.isclose(odds(fit), odds(table))


def test_rake_under_bounds():
    """A cell that is used up stops at what it has, and the margins are met all the same."""
    table = np.array([[10.0, 90.0], [100.0, 800.0]])
    chance, off = mixing.rake(table, [np.array([0.45, 0.55]), np.array([0.5, 0.5])], 200.0)
    assert off < 1e-6 and chance[0, 0] == 1 and chance.max() <= 1
    assert np.allclose(table * chance, [[10, 80], [90, 20]], atol=1e-3)
    # 0.2 of what a row of 100 of 1000 tokens can give.
    assert abs(mixing.largest(table, [np.array([0.2, 0.8]), np.array([0.11, 0.89])]) - 500) < 1
    # A budget that its targets don't allow misses some, and says so.
    assert mixing.rake(table, [np.array([0.5, 0.5]), np.array([0.5, 0.5])], 900.0)[1] > 0.1


def test_calibration_meets_the_budget():
    cells = {("a", "en", "x"): 600.0, ("b", "en", "x"): 300.0, ("b", "de", "x"): 100.0}
    plan = mixing.calibrated(cells, [{"a": 0.5, "b": 0.5}, {"en": 0.8, "de": 0.2}, {"x": 1.0}], 500.0)
    assert abs(sum(cells[c] * p for c, (_, p) in plan.cells.items()) - 500) < 1e-6 and plan.miss < 1e-6
    assert abs(sum(cells[c] * w for c, (w, _) in plan.cells.items()) - 1000) < 1e-6
    assert mixing.calibrated({}, [{}, {}, {}], None).cells == {}
    # Targets {} leave a margin as it is.
    free = mixing.calibrated({("*", "en", "*"): 600.0, ("*", "de", "*"): 400.0}, [{}, {"en": 0.5, "de": 0.5}, {}], None)
    assert abs(free.budget - 800) < 1 and free.miss < 1e-4


def test_query_shape_and_odd_rows(docs, odd, empty):
    rows = mixing.mixed(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r.probability <= 1 for r in rows)
    assert {r.mix_source for r in rows if r.source is None} == {mixing.OTHER}
    assert mixing.mixed(empty).count() == 0 and mixing.mixed(empty, details=False).count() == 0
    assert mixing.mixed(odd, details=False).columns == odd.columns


def test_names_that_clash_and_a_column_of_topics(spark):
    rows = [(k, "some words of a text", "src0", "en", "law" if k % 4 else "art", 3, "t", "z") for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, tokens long, _topic string, _tokens string")
    out = mixing.mixed(frame, topics_in="topic", topics={"law": 0.5, "art": 0.5})
    got = out.collect()
    assert len(set(out.columns)) == len(out.columns) and {r.topic_before for r in got} == {"law", "art"} and {
        (r.tokens, r.tokens_before, r["_topic"], r["_tokens"]) for r in got
    } == {(5, 3, "t", "z")}
    assert {r.topic: round(r.probability, 3) for r in got} == {"law": 0.333, "art": 1.0}
    assert mixing.mixed(frame, topics_in="topic", topics={"law": 0.5, "art": 0.5}, details=False).columns == frame.columns


def test_all_margins_meet_their_targets(spark):
    """At the query's defaults every margin is met; a budget beyond that misses some, and margins() says which."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for share in (None, 0.1, 0.6):
        told = {(r.margin, r.value): (r.target, r.expected) for r in mixing.margins(docs, budget_share=share).collect()}
        assert {m for m, _ in told} == set(mixing.MARGINS)
        worst = max(abs(t - e) for t, e in told.values())
        assert worst > 0.05 if share == 0.6 else worst < 2e-4
        rows = mixing.mixed(docs, budget_share=share).select("mix_source", "mix_lang", "topic", "tokens", "weight", "probability", "sampled").toPandas()
        kept = rows.tokens * rows.probability
        drawn = rows[rows.sampled]
        for margin, column in zip(mixing.MARGINS, ("mix_source", "mix_lang", "topic"), strict=True):
            got = kept.groupby(rows[column]).sum() / kept.sum()
            by_weight = (rows.tokens * rows.weight).groupby(rows[column]).sum() / rows.tokens.sum()
            assert all(abs(got[x] - told[margin, x][1]) < 1e-6 and abs(by_weight[x] - got[x]) < 1e-6 for x in got.index)
            if margin == "language" and share is None:
                sample = drawn.groupby(column).tokens.sum() / drawn.tokens.sum()
                assert all(abs(sample[x] - told[margin, x][0]) < 0.05 for x in sample.index)
        if share is None:
            assert kept.sum() > 0.16 * rows.tokens.sum()
    assert (rows.sampled == mixing.mixed(docs, budget_share=0.6).select("sampled").toPandas().sampled).all()


def brute_chances(cells, goals, budget, rounds=400):
    """Raking under bounds in plain Python: one value of one margin after the other, its factor by halving."""
    factor = [dict.fromkeys(goal, 1.0) for goal in goals]
    factor[0] = dict.fromkeys(goals[0], budget / sum(cells.values()))
    chance = lambda c: min(1.0, factor[0][c[0]] * factor[1][c[1]] * factor[2][c[2]])
    for _ in range(rounds):
        for axis, goal in enumerate(goals):
            for value, share in goal.items():
                mine = [c for c in cells if c[axis] == value]
                lo, hi = 0.0, 1e9
                for _ in range(80):
                    factor[axis][value] = (lo + hi) / 2
                    lo, hi = (factor[axis][value], hi) if sum(cells[c] * chance(c) for c in mine) < share * budget else (lo, factor[axis][value])
    miss = max(abs(sum(cells[c] * chance(c) for c in cells if c[axis] == v) / budget - share) for axis, goal in enumerate(goals) for v, share in goal.items())
    return {c: chance(c) for c in cells}, miss


def brute_cells(rows):
    """Tokens and cell of each document, tokens of each cell, and targets over the values that there are."""
    tokens = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    kind = lambda n: "long" if n >= 8000 else "article" if n >= 800 else "note"
    cell_of = {
        r["doc_id"]: (
            r["source"] if r["source"] in mixing.SOURCES else "*", r["lang"] if r["lang"] in mixing.LANGUAGES else "*", kind(len(r["text"] or ""))
        ) for r in rows
    }
    cells = {}
    for d, c in cell_of.items():
        cells[c] = cells.get(c, 0) + tokens[d]
    cells = {c: n for c, n in cells.items() if n}
    goals = []
    for axis, named in enumerate((mixing.SOURCES, mixing.LANGUAGES, mixing.TOPICS)):
        there = {c[axis] for c in cells}
        goals.append({k: v / sum(named[x] for x in there) for k, v in named.items() if k in there})
    return tokens, cell_of, cells, goals


def brute_draws(rows, budget):
    """doc_id: (the number drawn, the chance to stay)."""
    _, cell_of, cells, goals = brute_cells(rows)
    chances, _ = brute_chances(cells, goals, budget, 60)
    return {d: (int(hashlib.md5(f"42/{d}".encode()).hexdigest()[:13], 16) / 2**52, chances.get(c, 1.0)) for d, c in cell_of.items()}


def test_query_equals_brute_force(spark, docs):
    """Tokens, cells, raking under bounds and draws once more, in plain Python."""
    from granary.llm import queries

    rows = [r.asDict() for r in docs.collect()]
    tokens, cell_of, cells, goals = brute_cells(rows)
    plan = mixing.plan_of(docs)
    chances, miss = brute_chances(cells, goals, plan.budget, 60)
    assert miss < 1e-3
    # Not a larger one: its targets can't be met.
    assert brute_chances(cells, goals, 1.03 * plan.budget, 60)[1] > 1e-4
    draws = brute_draws(rows, plan.budget)
    for r in queries.op10_mixing(spark, "/root/testdata/sf0.001").collect():
        c = cell_of[r.doc_id]
        assert (r.tokens, r.mix_source, r.mix_lang, r.topic) == (tokens[r.doc_id], *c)
        if c in cells:
            assert r.probability == pytest.approx(chances[c], abs=0.02)
            assert r.weight == pytest.approx(r.probability * sum(cells.values()) / plan.budget, rel=1e-3)
        assert r.sampled == (draws[r.doc_id][0] < r.probability)
