import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from ledgerloom.llm import decontaminate, pii, toxicity
from ledgerloom.llm.queries import KEY, tokenizer_path
from tests.conftest import DATA
from tests.llm.test_simhash import plain_components, plain_fingerprint

LARGER = "/root/testdata/sf0.01"  # with labels enough to learn from


def test_run_equals_the_stages_done_plainly(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = toxicity.learn(docs, spark.read.parquet(f"{LARGER}/labels.parquet"))
    left = {r.doc_id: r.text for r in docs.collect() if model.score(r.text) < toxicity.THRESHOLD}
    assert len(left) < docs.count()
    groups = plain_components({i: plain_fingerprint(t) for i, t in left.items()}, 3)
    left = {i: t for i, t in left.items() if groups[i] == i}
    assert len(left) < len(groups)
    items = [decontaminate.normalised(r.text) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").collect()]
    index = decontaminate.Index(items)
    hits = index.search([decontaminate.normalised(t) for t in left.values()])
    clean = {i: t for (i, t), h in zip(left.items(), hits) if not h}
    assert len(clean) < len(left)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = {}
    for i, text in clean.items():
        text, _ = pii.replace_values(text, KEY.encode())
        expected[i] = tokenizer.encode(text, add_special_tokens=False).ids
    rows = entry.queries()["pipeline"](spark, LARGER).collect()
    assert {r.doc_id: r.ids for r in rows} == expected
    assert all(r.n_tokens == len(r.ids) for r in rows)


@pytest.mark.parametrize("name,stage", cp.STAGES[:-1])
def test_stages_return_the_columns_of_documents(spark, name, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = stage(spark, docs, DATA)
    assert out.schema.names == docs.schema.names
    assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert stage(spark, docs.limit(0), DATA).count() == 0


@pytest.mark.parametrize("name,stage", cp.STAGES)
def test_stages_take_odd_rows(spark, odd, name, stage):
    assert stage(spark, odd, DATA).count() >= 5


def test_every_operator_has_a_query():
    names = entry.queries()
    for n in range(1, 11):
        assert [q for q in names if q.startswith(f"op{n}_")]
    assert len(cp.STAGES) == 5
