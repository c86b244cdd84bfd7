"""Every operator on rows that share ids or have none: no row is lost, none gets another's result, reruns agree."""

from collections import Counter

import pytest

from tests.llm.edge import shared_ids
from vitrine.llm import decontamination, importance, jaccard_join, line_dedup, mixing, ngram_lm, privacy, quality, substring_dedup, toxicity


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def per_row(spark, run):
    """The result of two differently dealt copies, which must agree."""
    first, again = run(shared_ids(spark, 3)), run(shared_ids(spark, 1))
    assert first == again
    return first


CASES = {
    "mixing": lambda d: rows(mixing.mix_plan(d), "doc_id", "size", "target"),
    "quality": lambda d: rows(quality.judged(d), "doc_id", "n_words", "base_failed", "kept"),
    "line dedup": lambda d: rows(line_dedup.drop_repeated_lines(d, min_docs=3), "doc_id", "__n_lines", "__n_dropped", "__sha256"),
    "Jaccard join": lambda d: rows(jaccard_join.classes(d), "doc_id"),
    "importance": lambda d: rows(importance.ranked(d, d.where("doc_id = 0").select("text"), min_words=1), "doc_id", "imp_features", "imp_weight", "imp_score"),
    "privacy": lambda d: rows(privacy.spans(d, ["doc_id"]), "doc_id", "pii_base"),
    "substrings": lambda d: rows(substring_dedup.without_repeats(d), "doc_id", "text"),
}


@pytest.mark.parametrize("name", CASES)
def test_one_result_for_each_row(spark, name):
    found = per_row(spark, CASES[name])
    assert Counter(r[0] for r in found) == Counter(r.doc_id for r in shared_ids(spark).collect())


def test_substrings_keep_unique_words(spark):
    cut = {(r[0], r[1]) for r in CASES["substrings"](shared_ids(spark))}
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    assert {(0, words(0)), (1, words(2))} <= cut and any(i == 1 and t and t.split() == words(1).split() for i, t in cut)


def test_models_score_each_row(spark):
    docs = shared_ids(spark)
    scored = ngram_lm.scored(docs, ngram_lm.train(docs)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in scored) == Counter((r.doc_id, len((r.text or "").split()) + 1) for r in docs.collect())
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, toxic int")
    assert Counter(r.doc_id for r in toxicity.scored(docs, toxicity.fit(docs, labels)).collect()) == Counter(r.doc_id for r in docs.collect())


def test_contaminated_rows_go_alone(spark):
    docs = shared_ids(spark)
    item = spark.createDataFrame([(1, " ".join(f"w2x{i}" for i in range(20)))], "item_id long, text string")
    left = decontamination.decontaminated(docs, item)
    assert Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in docs.collect() if not (r.text or "").startswith("w2x"))
