"""Mixing sources to target weights by iterative proportional fitting.

The corpus is a table of tokens by cell: source x language x topic. Raking scales all cells of one margin's value so that their sum
meets that value's target, margin after margin, until every margin is met. A cell can give no more than the tokens that it has, so raking is
done under that bound: where cells of a value are used up, its others are scaled further. What a cell gives over what it has is the
probability of its documents. Without a budget, the sample is the largest that meets all targets; a budget beyond that meets what it can, and
``margins`` tells what it misses.

The margins' values are those that the targets name; all others of a margin share the value OTHER, so the driver holds at most
(sources + 1) x (languages + 1) x (topics + 1) cells, however many rows, documents or hosts there are.

Defined cases: null texts have no tokens, and such documents are kept with their cell's probability; null sources, languages and topics
are OTHER; targets {} leave a margin as it is; a target for a value that the corpus lacks is shared out over the others of its margin; a
doc_id that is null is drawn like the id 'null'; rows of equal doc_id share one draw; an empty table gives an empty result; extra columns
pass through, those that have the name of a result under another (``aside``).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, aside, free_names, text_of

OTHER = "*"
ROUNDS, TOLERANCE = 300, 1e-9
#: Shares that are as near as this to their targets are met, when the largest sample is looked for.
MET = 1e-4

#: Shares of tokens. Values not named share what OTHER gets; without OTHER they keep their present share.
SOURCES = {f"src{k}": 0.05 for k in range(20)}
LANGUAGES = {"en": 0.55, "de": 0.17, "fr": 0.17, "es": 0.11}
TOPICS = {"long": 0.3, "article": 0.5, "note": 0.2}


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def topic(text: Column) -> Column:
    """The kind of text by its form: long, article or note."""
    n = F.length(text)
    return F.when(n >= 8000, "long").when(n >= 800, "article").otherwise("note")


def value(column: str, named: dict[str, float]) -> Column:
    return F.when(F.col(column).isin([x for x in named if x != OTHER]), F.col(column)).otherwise(F.lit(OTHER))


def shares(named: dict[str, float], present: dict[str, float]) -> dict[str, float]:
    """Target shares over the values that the corpus has, adding up to 1."""
    total = sum(present.values())
    found = {k: v for k, v in named.items() if present.get(k, 0) > 0 and k != OTHER}
    rest = 0.0
    if present.get(OTHER, 0) > 0:
        rest = named[OTHER] if OTHER in named else present[OTHER] / total if sum(found.values()) else 1.0
    scale = (1 - rest) / (sum(found.values()) or 1)
    out = {k: v * scale for k, v in found.items()} | ({OTHER: rest} if present.get(OTHER, 0) > 0 else {})
    total = sum(out.values()) or 1
    return {k: v / total for k, v in out.items()}


def rake(table: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """Probabilities of the cells, 1 at most, under which the margins of table x probability are the targets (shares) of the budget and
    which keep the interactions of the table where no cell is used up; and the largest miss of a share that is left."""
    factors = [np.full(n, budget / table.sum()) if axis == 0 else np.ones(n) for axis, n in enumerate(table.shape)]
    spread = lambda axis, x: x.reshape([-1 if k == axis else 1 for k in range(table.ndim)])
    along = lambda axis, x: x.sum(axis=tuple(k for k in range(table.ndim) if k != axis))
    most, off = 1e12, 0.0
    for _ in range(rounds):
        for axis, target in enumerate(targets):
            others = np.ones([1] * table.ndim)
            for k, x in enumerate(factors):
                others = others * (1 if k == axis else spread(k, x))
            x, goal = factors[axis], target * budget
            # The factor at which what is used up and what is not add up to the goal, found in a few steps.
            for _ in range(30):
                full = spread(axis, x) * others >= 1
                fixed, free = along(axis, np.where(full, table, 0)), along(axis, np.where(full, 0, table * others))
                new = np.clip(np.divide(goal - fixed, free, out=x.copy(), where=free > 0), 1e-12, most)
                # Too much is used up: fewer cells must be.
                new = np.where(fixed > goal, x / 2, new)
                if np.allclose(new, x, rtol=1e-12):
                    break
                x = new
            factors[axis] = x
        chance = np.ones([1] * table.ndim)
        for k, x in enumerate(factors):
            chance = chance * spread(k, x)
        chance = np.minimum(1.0, chance)
        off = max(float(np.abs(along(k, table * chance) / budget - t).max()) for k, t in enumerate(targets))
        if off < tolerance:
            break
    return chance, off


def largest(table: np.ndarray, targets: list[np.ndarray]) -> float:
    """The largest budget at which all targets are met."""
    # No value can give more than it has.
    most = min(float((table.sum(axis=tuple(k for k in range(table.ndim) if k != axis))[t > 0] / t[t > 0]).min()) for axis, t in enumerate(targets))
    lo, hi = 0.0, most
    for _ in range(24):
        now = hi if lo == 0.0 and hi == most else (lo + hi) / 2
        if rake(table, targets, now, tolerance=MET)[1] < MET:
            lo = now
            if now == most:
                break
        elif now == most:
            # From here on by halves.
            lo, hi = most * 1e-9, now
        else:
            hi = now
    return lo


@dataclass
class Plan:
    """Of each cell its weight (share of the sample over share of the corpus) and probability; of each margin's value the target share and the
    share to expect; the largest miss of a share."""

    cells: dict[tuple, tuple[float, float]] = field(default_factory=dict)
    margins: list[tuple[str, str, float, float]] = field(default_factory=list)
    budget: float = 0.0
    miss: float = 0.0


MARGINS = ("source", "language", "topic")


def calibrated(cells: dict[tuple, float], named: list[dict[str, float]], budget: float | None = None) -> Plan:
    """The plan for cells of so many tokens, targets by margin and a budget of tokens (None: the largest that meets all targets)."""
    total = sum(cells.values())
    if not total:
        return Plan({k: (1.0, 1.0) for k in cells})
    values, targets = [], []
    for axis, names in enumerate(named):
        present: dict[str, float] = {}
        for cell, n in cells.items():
            present[cell[axis]] = present.get(cell[axis], 0) + n
        goal = shares(names, present)
        values.append(sorted(present))
        targets.append(np.array([goal.get(x, 0.0) for x in values[-1]]))
    table = np.zeros([len(x) for x in values])
    at = {cell: tuple(values[axis].index(x) for axis, x in enumerate(cell)) for cell in cells}
    for cell, n in cells.items():
        table[at[cell]] = n
    if budget is None:
        budget = largest(table, targets)
    chance, miss = rake(table, targets, min(budget, total))
    given = table * chance
    plan = Plan(budget=float(given.sum()), miss=miss)
    plan.cells = {cell: (float(chance[k] * total / given.sum()), float(chance[k])) for cell, k in at.items()}
    for axis, margin in enumerate(MARGINS[: table.ndim]):
        got = given.sum(axis=tuple(k for k in range(table.ndim) if k != axis)) / given.sum()
        plan.margins += [(margin, x, float(t), float(g)) for x, t, g in zip(values[axis], targets[axis], got, strict=True)]
    return plan


def draw(doc_id: Column, seed: int) -> Column:
    """A number from 0 to 1 that depends on the id and the seed alone, so that a task that runs again draws the same."""
    return F.conv(
        F.substring(F.md5(F.concat_ws("/", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10
    ).cast("double") / float(1 << 52)


def counted(docs: DataFrame, named: list[dict[str, float]], text: str, source: str, lang: str, topics_in: str | None) -> tuple[
    DataFrame, list[str], dict[tuple, float]
]:
    """docs with their cells and tokens, the names of those columns, and the tokens of each cell."""
    names = free_names(docs, "mix_source", "mix_lang", "topic", "tokens")
    rows = docs.withColumns(
        {
            names[0]: value(source, named[0]),
            names[1]: value(lang, named[1]),
            names[2]: F.col(topics_in) if topics_in else topic(text_of(text)),
            names[3]: tokens(text_of(text)),
        }
    )
    rows = rows.withColumn(names[2], value(names[2], named[2]))
    found = rows.groupBy(*names[:3]).agg(F.sum(names[3])).collect()
    return rows, names, {tuple(r[:3]): float(r[3] or 0) for r in found}


def _targets(*given: dict[str, float] | None) -> list[dict[str, float]]:
    return [own if x is None else x for x, own in zip(given, (SOURCES, LANGUAGES, TOPICS), strict=True)]


def plan_of(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topics_in: str | None = None,
    sources: dict | None = None,
    languages: dict | None = None,
    topics: dict | None = None,
    budget_share: float | None = None,
) -> Plan:
    """The plan that ``mixed`` draws by."""
    named = _targets(sources, languages, topics)
    _, _, cells = counted(docs, named, text, source, lang, topics_in)
    return calibrated(cells, named, None if budget_share is None else budget_share * sum(cells.values()))


def margins(docs: DataFrame, **more) -> DataFrame:  # noqa: ANN003
    """(margin, value, target, expected) for the sample that ``mixed`` draws with the same arguments: shares of its tokens."""
    return docs.sparkSession.createDataFrame(plan_of(docs, **more).margins, "margin string, value string, target double, expected double")


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topics_in: str | None = None,
    sources: dict | None = None,
    languages: dict | None = None,
    topics: dict | None = None,
    budget_share: float | None = None,
    seed: int = 42,
    details: bool = True,
) -> DataFrame:
    """docs with mix_source, mix_lang, topic, tokens, weight, probability and sampled; without details, the sampled rows and their
    own columns alone. topics_in: a column of topics; without one, a topic is the kind of text by its length. budget_share: the share of the
    corpus's tokens to expect; None: the largest that meets all targets."""
    results = ["mix_source", "mix_lang", "topic", "tokens", "weight", "probability", "sampled"]
    if details:
        docs, read = aside(docs, results, [doc_id, text, source, lang, topics_in or doc_id])
        doc_id, text, source, lang, topics_in = [*read[:4], topics_in and read[4]]
    named = _targets(sources, languages, topics)
    rows, names, cells = counted(docs, named, text, source, lang, topics_in)
    plan = calibrated(cells, named, None if budget_share is None else budget_share * sum(cells.values())).cells
    key = F.concat_ws("\x00", *names[:3])
    look_up = lambda k: F.coalesce(
        F.element_at(F.create_map(*(F.lit(x) for cell, got in plan.items() for x in ("\x00".join(cell), got[k]))), key), F.lit(1.0)
    ) if plan else F.lit(1.0)
    sampled = draw(F.col(doc_id), seed) < look_up(1)
    if not details:
        return rows.filter(sampled).select(*docs.columns)
    made = [*(F.col(x) for x in names), look_up(0), look_up(1), sampled]
    return rows.select(*docs.columns, *(c.alias(x) for c, x in zip(made, results, strict=True)))
