"""The pipeline stage by stage on the smallest table: each against what its operator must do to its own input."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fathomline.functions.staging import new_path
from fathomline.llm import mixing
from fathomline.llm.common import table
from tests.conftest import SMALL
from tests.llm.test_edges import brute_lines
from tests.llm.test_queries import assert_packed
from tests.llm.test_similar import brute_kept


@pytest.fixture(scope="module")
def steps(spark):
    now, out = table(spark, SMALL, "documents"), []
    out.append(now)
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, name)
        stage(spark, now, SMALL).write.parquet(path)
        now = spark.read.parquet(path)
        out.append(now)
    return [x.toPandas() for x in out]


def test_registered(spark, steps):
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mix", "best_fit_packing"]
    assert all(list(x.columns) == list(steps[0].columns) for x in steps[1:5])
    assert corpus_pipeline.run(spark, SMALL).count() == len(steps[5])


def test_quality_keeps_clean_documents(spark, steps):
    labels = table(spark, SMALL, "labels").toPandas().merge(steps[0], on="doc_id")
    clean = labels[(labels.quality == 1) & (labels.text.str.split().str.len() >= 20)]
    junk = labels[labels.quality == 0]
    kept = set(steps[1].doc_id)
    assert len(set(clean.doc_id) - kept) == 0
    assert len(set(junk.doc_id) & kept) < 0.6 * len(junk)
    assert (steps[1].text.str.len() == steps[1].n_chars).all()


def test_lines(steps):
    want = sorted(brute_lines(list(zip(steps[1].doc_id.tolist(), steps[1].text.tolist()))))
    assert sorted(zip(steps[2].doc_id.tolist(), steps[2].text.tolist())) == [(i, t) for i, _, _, t in want]


def test_near_duplicates(steps):
    assert sorted(steps[3].doc_id) == brute_kept(list(zip(steps[2].doc_id.tolist(), steps[2].text.tolist())))


def test_mix_meets_targets(steps):
    size = lambda d: d.assign(size=d.text.str.encode("utf-8").map(lambda b: len(b.split()))).groupby("source")["size"].sum()
    had, took = size(steps[3]).sort_index(), size(steps[4])
    want = mixing.targets(had.tolist(), [(3, 1, 2)[k % 3] for k in range(len(had))])
    assert all(abs(took.get(s, 0) - w) <= 1.5 * mixing.BLOCK for s, w in zip(had.index, want))


def test_sequences(steps):
    assert_packed(steps[5], 2048)
    assert set(steps[5].doc_id) == set(steps[4].doc_id)
    assert steps[5].sequence_id.nunique() <= 1.01 * steps[5].length.sum() / 2048 + 1
