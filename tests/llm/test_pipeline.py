"""The corpus pipeline, stage by stage and as a whole, against brute force."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from brookmart.llm import decontamination, quality_rules
from brookmart.llm.common import written
from tests.llm.test_operators import brute_components

SF_DIR = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "personal data", "byte-pair encoding"]
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        states.append(written(stage(spark, states[-1], SF_DIR), "test"))
    assert all(s.columns == docs.columns for s in states[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in states]
    judged = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert set(rows[1]) == judged and 0 < len(judged) < len(rows[0])
    components = brute_components([(k, r.text) for k, r in rows[1].items()])
    assert set(rows[2]) == {k for k, n, c in components if k == c}
    items = [decontamination.normal(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    leaking = {k for k, r in rows[2].items() if any(i in decontamination.normal(r.text) for i in items)}
    assert leaking and leaking <= set(rows[2]) - set(rows[3])
    assert len(set(rows[2]) - set(rows[3])) <= len(leaking) + 3  # the rest leaks with edits
    assert set(rows[4]) == set(rows[3]) and all(r.n_chars == len(r.text) for r in rows[4].values())
    assert 0 < sum(rows[4][k].text != rows[3][k].text for k in rows[4]) < len(rows[4]) / 2
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for k, r in rows[4].items():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want.add((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    assert {tuple(r) for r in rows[5].values()} == want
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF_DIR).collect()} == want


def test_pipeline_awkward_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, extra columns with the names of inner columns; empty tables."""
    prose = "the old river runs slowly past the mill. every morning a boat with two men comes down from the hills to sell bread and salt to people. "
    long = prose + "later in the year the water is high and nobody crosses it except the old miller and his two grey dogs. "
    made = [(1, long, "en", "s", 1, "a"), (1, long, "en", "s", 1, "a"), (2, long + "and more.", None, None, None, None), (3, None, "en", "s", 0, "b"),
            (None, "another text about " + prose + " ends here.", "en", "s", 9, "c"), (5, "", "en", "s", 0, "d"), (6, "salt " * 300, "en", "s", 5, "e")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, leaks string"
    for name, rows in (("some", made), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "some")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "None"]
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
