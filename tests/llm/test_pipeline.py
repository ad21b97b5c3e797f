"""The pipeline's stages one by one, and as a whole."""

import hashlib

import corpus_pipeline
from strikehaz.llm.queries import piece_model

SF = "/root/testdata/sf0.01"


def test_stages_keep_their_contract(spark, tmp_path):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and len(set(counts)) == len(counts) and counts[-1] > 0.6 * counts[0]
    rows = docs.collect()
    assert len({r.text for r in rows}) == len(rows)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in r.text for r in rows for i in items)
    want = {(r.doc_id, len(ids := lib.encode(r.text)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for r in rows}
    got = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_take_edge_rows(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, "/root/testdata/sf0.001")
            assert got.count() <= docs.count()
