"""Registered queries against their SQL on the smallest tables; the pipeline stage by stage against plain versions."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import odd  # noqa: E402
from oracle import compare, connect  # noqa: E402

import corpus_pipeline  # noqa: E402
from redline.llm import catalogue, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, name):
    ok, message = compare(catalogue.QUERIES[name](spark, SF), connect(SF), catalogue.ORACLES[name])
    assert ok, message


def test_pipeline_stage_by_stage(spark):
    spm = pytest.importorskip("sentencepiece")
    import hashlib
    from redline.llm.common import table
    docs = table(spark, SF, "documents")
    (_, toxic), (_, lines), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    a = toxic(spark, docs, SF)
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    fine = {r.doc_id for r in docs.collect() if toxicity.score_texts([r.text], model)[0] < 0.3}
    assert a.columns == docs.columns and {r.doc_id for r in a.collect()} == fine
    b = lines(spark, a, SF)
    want = odd.line_dedup([(r.doc_id, r.text) for r in a.collect()])
    assert b.columns == docs.columns
    kept = {k[0]: v[2] for k, v in want.items() if odd.WORDS.search(v[2] or "") or not odd.WORDS.search(k[1] or "")}
    assert {r.doc_id: r.text for r in b.collect()} == kept and len(kept) < len(want)
    c = near(spark, b, SF)
    parts = odd.near_dup([(r.doc_id, r.text) for r in b.collect()], 80)
    assert sorted(r.doc_id for r in c.collect()) == sorted(i for i, (_, p) in parts.items() if i == p)
    d = mix(spark, c, SF)
    once = {r.doc_id for r in c.collect()}
    turns = [r.doc_id for r in d.collect()]
    assert set(turns) == once and max(turns.count(i) for i in once) <= 2
    import public_tokenizers
    sp = spm.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in c.collect()}
    for r in encode(spark, d, SF).collect():
        ids = sp.encode(texts[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_pipeline_drops_near_copies_from_similarity_080(spark):
    """Pairs of 0.80 to 0.849 go too, one just below 0.80 stays, and the stage equals a comparison of all pairs at 80."""
    base = [[f"w{k}x{i}" for i in range(104)] for k in range(40)]
    data = []
    for k, words in enumerate(base):
        data.append((2 * k, " ".join(words)))
        extra = 25 if k % 2 else 26  # 100 shingles of 125, or of 126
        data.append((2 * k + 1, " ".join(words + [f"y{k}x{i}" for i in range(extra)])))
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(data, "doc_id long, text string"), SF)
    want = odd.near_dup(data, 80)
    got = {r.doc_id for r in out.collect()}
    assert got == {i for i, (_, p) in want.items() if i == p} and len(got) == 60
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = odd.near_dup([(r.doc_id, r.text) for r in docs.collect()], 80)
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert got == {i for i, (_, p) in want.items() if i == p}


def test_emptied_documents_go_and_empty_ones_stay(spark):
    data = [(1, "a line of some length\nanother long line"), (2, "another long line\n a LINE of some length \n\n"), (3, ""),
            (4, None), (5, " \n"), (6, "another long line\nok")]
    out = corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(data, "doc_id long, text string"), SF)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, data[0][1]), (3, ""), (4, None), (5, " \n"), (6, "ok")]


def test_stages_take_awkward_and_empty_tables(spark):
    for data in (odd.rows(), []):
        docs = odd.documents(spark, data)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), odd.DOC_SCHEMA)
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
