"""The pipeline's stages against what the operators' own brute-force versions keep."""

import corpus_pipeline
import public_tokenizers
import test_linededup
import test_mixing
import test_quality
import test_simhash
from tokenizers import Tokenizer

from granary.llm import mixing, quality


def test_stages(spark, docs):
    at, frame = "/root/testdata/sf0.001", docs
    want = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:4]:
        frame = stage(spark, frame, at)
        assert frame.columns == docs.columns
        got = sorted(frame.collect(), key=lambda r: r.doc_id)
        if name == "quality rules":
            want = [r for r in want if test_quality.brute_kept(r["text"])]
        elif name == "line dedup":
            left = {d: t for d, _, _, t in test_linededup.brute([(r["doc_id"], r["text"]) for r in want])}
            want = [r | {"text": left[r["doc_id"]], "n_chars": len(left[r["doc_id"]])} for r in want]
        elif name == "simhash near-dedup":
            groups = test_simhash.brute_similar_groups([r["text"] for r in want])
            best = {}
            for r in want:
                best.setdefault(groups[r["text"]], r)
            want = sorted(best.values(), key=lambda r: r["doc_id"])
        else:
            budget = mixing.plan_of(spark.createDataFrame(want, docs.schema)).budget
            drawn = test_mixing.brute_draws(want, budget)
            kept = {r.doc_id for r in got}
            # Two ways of raking agree to a few thousandths, so a draw that close to its chance may go either way.
            assert all((u < chance) == (d in kept) for d, (u, chance) in drawn.items() if abs(u - chance) > 0.02)
            want = [r for r in want if r["doc_id"] in kept]
        assert [r.asDict() for r in got] == want, name
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, at).collect()
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {r["doc_id"]: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in want}


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").collect()}
    long_enough = {r.doc_id for r in quality.judged(docs).filter("not quality.base_failed").collect()}
    kept = {r.doc_id for r in quality.keep(docs).collect()}
    assert len(good & long_enough - kept) <= 0.01 * len(good & long_enough)
