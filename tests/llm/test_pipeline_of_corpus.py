import corpus_pipeline
import pytest
from test_decontaminate import expected as decontaminated
from test_near_copies import brute_force

from marketpulse.llm import frames, registry, toxicity

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """The tables between the stages, each written and read again."""
    folder = frames.shared_folder(spark, "stages")
    tables = {"documents": registry.table(spark, SMALL, "documents")}
    docs = tables["documents"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        docs = tables[name] = spark.read.parquet(f"{folder}/{name}")
    return tables


def ids(table):
    return {r.doc_id for r in table.select("doc_id").collect()}


def test_columns(stages):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert all(stages[n].columns == COLUMNS for n in names[:-1])
    assert stages[names[-1]].columns[:5] == COLUMNS


def test_toxic_documents_go(spark, stages):
    report = toxicity.report(stages["documents"], registry.table(spark, SMALL, "labels")).collect()
    assert ids(stages["toxicity"]) == {r.doc_id for r in report if not r.predicted}


def test_one_document_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages["toxicity"].collect()]
    near = brute_force(rows, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT)
    assert ids(stages["ngram_jaccard_join"]) == {i for i, _, component in near if i == component}


def test_no_passage_of_the_benchmark_is_left(spark, stages):
    items = [(r.item_id, r.text) for r in registry.table(spark, SMALL, "benchmark").collect()]
    before = {r.doc_id: r.text for r in stages["ngram_jaccard_join"].collect()}
    after = {r.doc_id: r.text for r in stages["benchmark_decontamination"].collect()}
    assert not any(row[-1] for row in decontaminated(list(after.items()), items))
    clean = [row[0] for row in decontaminated(list(before.items()), items) if not row[-1]]
    assert len(clean) < len(before) and all(after[i] == before[i] for i in clean)


def test_tokens_decode_to_the_text(stages):
    last = stages["bpe_encoding"]
    assert last.count() == stages["secret_scans"].count() == last.where("round_trip").count()


def test_run_equals_its_stages(spark, stages):
    got = {(r.doc_id, r.text, r.n_tokens) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {(r.doc_id, r.text, r.n_tokens) for r in stages["bpe_encoding"].collect()}
