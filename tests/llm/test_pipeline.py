"""The pipeline against each stage worked by hand on what its predecessor kept."""

import itertools
import re

import pyarrow as pa

import corpus_pipeline
from motrac.llm import quality, toxicity
from motrac.llm.common import scratch_path, table
from tests.llm.test_copies import _fingerprint, _groups
from tests.llm.test_tokens import _check_packing


def _norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "exact dedup", "near dedup", "packing"]


def test_pipeline_equals_stages_by_hand(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    of = lambda ids: docs.where(docs["doc_id"].isin(sorted(ids)))

    model = quality.fit(docs, labels)
    shares = quality.term_rows(pa.array([t or "" for t in rows.values()], pa.string()), quality.Terms(model.vocabulary))
    score = dict(zip(rows, (s for x in shares for s in model.score(x))))
    kept = {i for i in rows if score[i] >= 0.3}
    assert 0 < len(kept) < len(rows)

    chance = toxicity.fit(of(kept), labels).severity(pa.array([rows[i] or "" for i in sorted(kept)], pa.string()))[1]
    kept = {i for i, c in zip(sorted(kept), chance) if c < 0.5}

    first = {}
    for i in sorted(kept):
        first.setdefault(_norm(rows[i]), i)
    kept = set(first.values())

    fp = {i: _fingerprint(rows[i]) for i in kept}
    near = [(a, b) for a, b in itertools.combinations(sorted(kept), 2) if bin(fp[a] ^ fp[b]).count("1") <= 4]
    kept = {i for i, g in _groups(kept, near).items() if i == g}

    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == kept
    assert len({(r["doc_id"], r["piece"]) for r in got}) == len(got)
    assert _check_packing(got, 4096) == -(-sum(r["length"] for r in got) // 4096)


def test_classifier_stages_with_repeats_nulls_and_clashing_columns(spark, sf_dir, docs, no_docs):
    """Rows that stay are those the operators keep, each as often as it was there and with all its columns."""
    table(spark, sf_dir, "labels").write.mode("overwrite").parquet(path := scratch_path(spark, "labels") + "/labels.parquet")
    labels, folder = table(spark, sf_dir, "labels"), path.rsplit("/", 1)[0]
    for stage, scored in ((corpus_pipeline.keep_quality, quality.score_quality(docs, labels).where("predicted = 1")), (corpus_pipeline.drop_toxic, toxicity.score_toxicity(docs, labels).where("toxic = 0"))):
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns
        rows = [tuple(r) for r in got.collect()]
        assert 0 < len(rows) and set(rows) <= {tuple(r) for r in docs.collect()} and len(set(rows)) == len(rows)
        assert sorted(r[0] or 0 for r in rows) == sorted(r["doc_id"] or 0 for r in scored.collect())
        assert stage(spark, no_docs, folder).count() == 0


def test_copies_stage_with_repeats_nulls_and_clashing_columns(spark, docs, no_docs, texts):
    got = corpus_pipeline.drop_copies(spark, docs, "")
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({_norm(t) for _, t in texts}) and len({_norm(r["text"]) for r in rows}) == len(rows)
    assert corpus_pipeline.drop_copies(spark, no_docs, "").count() == 0


def test_near_copies_stage_with_repeats_nulls_and_clashing_columns(spark, docs, no_docs, texts):
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) and 1 in ids and 13 in ids
    assert corpus_pipeline.drop_near_copies(spark, no_docs, "").count() == 0


def test_near_copies_stage_keeps_every_text_without_or_with_a_shared_id(spark):
    own = ["alpha beta gamma delta epsilon zeta", "one river runs past seven quiet towns", "her letters arrived late in the winter", "we sold the boat and bought two goats", "nine engines failed before the last test"]
    rows = [(None, own[0]), (None, own[1]), (None, own[1]), (7, own[2]), (7, own[3]), (7, own[3]), (3, own[4]), (None, own[4]), (9, own[2])]
    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, own[0]), (0, own[1]), (7, own[2]), (7, own[3]), (3, own[4])])
