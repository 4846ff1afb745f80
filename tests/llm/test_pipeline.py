"""The pipeline's stages against plain restatements of what each must do."""

from collections import Counter

import pytest

from postlens.llm import packing, toxicity
from tests.llm.helpers import DOCS, ROWS
from tests.llm.test_mixing import targets
from tests.llm.test_packing import check, ids_of
from tests.llm.test_simhash import brute_components, slow_fingerprint

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_small):
    from postlens.llm.common import stage
    docs, out = spark.read.parquet(f"{sf_small}/documents.parquet"), []
    for name, step in pipeline.STAGES:
        out.append(docs)
        docs = stage(step(spark, docs, sf_small), "test-stage")
    return [*out, docs]


def test_stages_are_named_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "mix_sources", "pack"]
    assert pipeline.ORACLE_SQL is None


def test_all_but_the_last_return_documents(stages):
    for df in stages[1:-1]:
        assert df.schema.simpleString() == stages[0].schema.simpleString()


def test_toxic_documents_go(spark, sf_small, stages):
    scores = toxicity.score_documents(stages[0], spark.read.parquet(f"{sf_small}/labels.parquet")).collect()
    assert Counter(r.doc_id for r in stages[1].collect()) == Counter(r.doc_id for r in scores if not r.predicted)


def test_one_of_each_group_stays(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    ids = sorted(before)
    want = set(brute_components(ids, [slow_fingerprint(before[i]) for i in ids]))
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(want)


def test_mixed_to_targets(stages):
    before, after = stages[2].collect(), Counter(r.doc_id for r in stages[3].collect())
    words = {r.doc_id: len((r.text or "").split()) for r in before}
    source = {r.doc_id: r.source for r in before}
    assert set(after) <= set(words) and max(after.values()) <= 2
    sizes = Counter()
    for d, n in words.items():
        sizes[source[d]] += n
    want = targets(dict(sizes))
    taken = Counter()
    for d, n in after.items():
        taken[source[d]] += n * words[d]
    assert abs(sum(taken.values()) - sum(want.values())) < 0.1 * sum(want.values())
    assert all(taken[s] <= want[s] + 1e-6 for s in want)


def test_packed(stages):
    from tokenizers import Tokenizer
    reference = Tokenizer.from_file(packing.default_tokenizer())
    rows, pieces = stages[3].collect(), stages[4].collect()
    check(pieces, {r.doc_id: ids_of(reference, r.text) for r in rows})
    assert sum(p.length for p in pieces) == sum(len(ids_of(reference, r.text)) for r in rows)


def test_run_is_the_stages(spark, sf_small, stages):
    got = pipeline.run(spark, sf_small)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(got) == key(stages[-1])


def test_awkward_rows_pass_every_stage(spark, sf_small):
    docs = spark.createDataFrame([(i if i is None else i + 10_000_000, *r) for i, *r in ROWS], DOCS)
    for _, step in pipeline.STAGES[:-1]:
        docs = step(spark, docs, sf_small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert pipeline.STAGES[-1][1](spark, docs, sf_small).count() > 0
    for _, step in pipeline.STAGES:
        assert step(spark, spark.createDataFrame([], DOCS), sf_small).count() == 0
