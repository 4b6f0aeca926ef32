"""Document fingerprints by SpotSigs. DataFrame operations only.

A text is lower-cased and cut into words of letters and digits. After each common word, the anchor, the next ``CHAIN`` content words
form a chain; anchor and chain together are a signature. Stretches of ``STRETCH`` or more content words without an anchor, as in
lists and tables, give one chain at each of their words. A text that has neither is its own single signature. The fingerprint is the set of the signatures'
64-bit hashes.

Two fingerprints are as alike as their sets' Jaccard similarity. A pair whose set lengths differ by more than the threshold
allows is pruned before its sets are compared.

Defined cases: null and empty texts, and texts without letters or digits, have the empty set, and two empty sets are alike to 1;
equal texts have equal sets, repeated rows too; an empty table gives an empty result; extra columns pass through ``signed``, one that has
the result's name under another (``aside``).
"""

from __future__ import annotations

from math import ceil, log, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import aside, free_names, partitions, text_of, written

CHAIN, STRETCH, THRESHOLD = 2, 6, 0.8
#: Buckets of rows for a task.
TASK_BUCKETS = 8
#: Common words of English, German, French and Spanish.
ANCHORS = tuple(
    """a an the and or of to in on at by for from with as is are was be it this that
    der die das den dem des ein eine und oder von zu im auf mit für als ist nicht sich
    le la les un une du de et en dans sur pour par avec que qui est pas au
    el los las y del con por no su se es al""".split()
)


def signed(
    df: DataFrame, text: str = "text", into: str = "signatures", anchors: tuple[str, ...] = ANCHORS, chain: int = CHAIN, stretch: int = STRETCH
) -> DataFrame:
    """df with the sorted array of the signatures' hashes. Steps that are used twice are columns of their own, so that each runs
    once."""
    df, [text] = aside(df, [into], [text])
    words, marked, both = free_names(df, "words", "marked", "both")
    content, common = r"[^# ][^ ]*+", r"#[^ ]++"
    df = df.withColumn(words, F.trim(F.regexp_replace(F.lower(text_of(text)), r"[^\p{L}\p{N}\p{M}]+", " ")))
    # Common words get a # in front: no word has one by now.
    df = df.withColumn(marked, F.regexp_replace(words, rf"(?<![^ ])({'|'.join(anchors)})(?![^ ])", "#$1"))
    chains = F.regexp_extract_all(marked, F.lit(rf"(?<![^ ])(?=({common}" + rf"(?: {common})*+ {content}" * chain + "))"), F.lit(1))
    # Anchor and content words; common words between them go.
    anchored = F.transform(chains, lambda x: F.xxhash64(F.regexp_replace(x, rf" {common}", "")))
    bare = F.regexp_extract_all(marked, F.lit(rf"(?<![^ ])(?:{content}(?: |$)){{{stretch},}}+"), F.lit(0))
    lone = F.regexp_extract_all(F.array_join(bare, " # "), F.lit(rf"(?<![^ ])(?=({content}" + rf" {content}" * chain + "))"), F.lit(1))
    df = df.withColumn(both, F.array_union(anchored, F.transform(lone, lambda x: F.xxhash64(x))))
    whole = F.when(F.col(words) != "", F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(into, F.when(F.size(both) > 0, F.sort_array(both)).otherwise(whole)).drop(words, marked, both)


def digest(signed: Column) -> Column:
    """A short name of a fingerprint: how many signatures, and a digest of them all."""
    return F.concat_ws("-", F.size(signed).cast("string"), F.md5(F.array_join(signed.cast("array<string>"), ",")))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two fingerprints. Pairs whose lengths alone hold it below ``least`` are pruned: they give 0."""
    x, y = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    full = F.when((x == 0) & (y == 0), F.lit(1.0)).otherwise(shared / F.greatest(x + y - shared, F.lit(1)))
    return F.when(F.least(x, y) < least * F.greatest(x, y), F.lit(0.0)).otherwise(full) if least else full


def bucketed(base: DataFrame, place: str, into: str, rows: int, most: int = 1 << 20) -> tuple[DataFrame, int]:
    """base with a column ``into``: the number of its bucket in the order of ``place``, of about ``rows`` rows each; and about how many buckets
    there are. Quantiles of the whole table
    and, within each part that they cut, quantiles of the part are what rows are compared with: ``most`` numbers at most, 8 MB, whatever
    the table's size."""
    k = min(most, max(1, base.count() // rows))
    width = ceil(sqrt(k))
    if width < 2:
        return base.withColumn(into, F.lit(0).cast("long")), 1
    at = [x / width for x in range(1, width)]
    cuts = sorted(set(base.select(F.percentile_approx(place, at, 10_000)).first()[0] or []))
    part, inner = free_names(base, "part", "inner")
    above = lambda edges: F.size(F.filter(edges, lambda x: x <= F.col(place))).cast("long")
    base = base.withColumn(part, above(F.array(*map(F.lit, cuts))))
    fine = base.groupBy(part).agg(F.array_distinct(F.percentile_approx(place, at, 10_000)).alias(inner))
    return base.join(F.broadcast(fine), part).withColumn(into, F.col(part) * width + above(F.col(inner))).drop(part, inner), k


def followed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = 500) -> DataFrame:
    """doc_id, text (null: empty), signatures, and next_text and next_signatures: those of the next row in the order of doc_id, null ids
    first, ties by text hash; after the last row comes the first. Quantiles of doc_id cut the rows into buckets of about ``rows``
    rows, so no task orders the whole table. The first row of each bucket goes to the bucket before too, the very first to the last."""
    base = docs.select(F.coalesce(F.col(doc_id), F.lit(-(1 << 63))).alias("place"), F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    base, k = bucketed(base, "place", "bucket", rows)
    # One row a bucket, so one task can order them.
    starts = base.groupBy("bucket").agg(F.min("place").alias("place"))
    every = Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = starts.withColumn("to", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(whole)))
    tie = Window.partitionBy("bucket").orderBy(F.xxhash64("text"))
    heads = base.join(F.broadcast(starts), ["bucket", "place"]).withColumn("row", F.row_number().over(tie)).filter("row = 1")
    heads = heads.select(F.col("to").alias("bucket"), "place", "doc_id", "text", F.lit(True).alias("head"))
    both = base.select("bucket", "place", "doc_id", "text", F.lit(False).alias("head")).unionAll(heads)
    # Tasks grow in number with the buckets, not in size. Each text is signed once, where it meets the next one.
    both = both.repartition(max(partitions(docs.sparkSession), k // TASK_BUCKETS), "bucket")
    order = Window.partitionBy("bucket").orderBy("head", "place", F.xxhash64("text"))
    ranked = signed(both.withColumn("next_text", F.lead("text").over(order))).withColumn("next_signatures", F.lead("signatures").over(order))
    return ranked.filter("not head").select("doc_id", "text", "signatures", "next_text", "next_signatures")


def pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Near duplicates: (a, b, similarity) between classes of equal fingerprints, each named by its smallest doc_id, and the
    membership (doc_id, class_id). Sets are partitioned by length so that only those of the same or the next partition can be alike
    enough; within them, sets meet by their rarest signatures, one of which alike sets must share, and their lengths and places prune the pair
    before the sets are compared."""
    prints = written(signed(docs.select(F.col(doc_id).alias("doc_id"), text), text).select("doc_id", "signatures"), "spots")
    named = prints.withColumn("name", digest(F.col("signatures")))
    classes = named.groupBy("name").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures"))
    classes = written(classes, "spot-classes")
    members = named.select("doc_id", "name").join(classes.select("name", "class_id"), "name").select("doc_id", "class_id")
    found = classes.filter(F.size("signatures") > 0).select("class_id", "signatures", F.size("signatures").alias("n"))
    # Signatures are shuffled once, to be counted where they lie; only those of several sets go on to be ranked. A set's others are its rarest, so
    # that their number alone tells the places of the rest.
    spread = found.select("class_id", "n", F.explode("signatures").alias("s"))
    shared = spread.withColumn("df", F.count("*").over(Window.partitionBy("s"))).filter("df > 1")
    inside = Window.partitionBy("class_id")
    before = F.col("n") - F.count("*").over(inside)
    ranked = shared.withColumn("place", before + F.row_number().over(inside.orderBy("df", "s")))
    prefix = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-6) + 1)
    prefix = prefix.withColumn("part", F.floor(F.log(F.col("n").cast("double")) / -log(threshold)))
    prefix = written(prefix.select("s", "part", "class_id", "n", "place"), "spot-prefixes")
    left = prefix.select("s", "part", F.col("class_id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"))
    right = prefix.select(
        "s",
        F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"),
        F.col("class_id").alias("b"),
        F.col("n").alias("n_b"),
        F.col("place").alias("p_b"),
    )
    alike = (F.col("a") != F.col("b")) & ((F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))) & (
        F.col("n_b") >= threshold * F.col("n_a")
    )
    # With the first shared signature at p_a and p_b, so much can be shared at most.
    room = F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) + 1
    # A product that is whole may come out a little above.
    need = F.ceil(threshold / (1 + threshold) * (F.col("n_a") + F.col("n_b")) - 1e-6)
    met = left.join(right.hint("merge"), ["s", "part"]).filter(alike).groupBy("a", "b").agg(
        F.max(room).alias("room"), F.first(need).alias("need")
    ).filter("room >= need").select("a", "b")
    met = written(met, "spot-candidates")
    # The sets of candidates alone move to meet each other.
    ends = met.select(F.col("a").alias("class_id")).unionAll(met.select("b")).distinct()
    sets = written(found.select("class_id", "signatures").join(ends, "class_id", "left_semi"), "spot-sets")
    sets_a = sets.select(F.col("class_id").alias("a"), F.col("signatures").alias("x"))
    sets_b = sets.select(F.col("class_id").alias("b"), F.col("signatures").alias("y"))
    scored = met.join(sets_a, "a").join(sets_b, "b").select("a", "b", likeness(F.col("x"), F.col("y"), threshold).alias("similarity"))
    return scored.filter(F.col("similarity") >= threshold), members


def linked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of an equal fingerprint) and n_links, the number of other classes that are near duplicates of its
    own."""
    found, members = pairs(docs, doc_id, text, threshold)
    found = written(found, "spot-pairs")
    ends = found.select(F.col("a").alias("class_id")).unionAll(found.select("b"))
    counts = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(counts, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
