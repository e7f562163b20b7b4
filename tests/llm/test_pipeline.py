import pytest

from tests.conftest import DATA
from tests.llm.conftest import ODD
from tests.llm.test_operators import base_counts, brute_components, ids_of

@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(DATA)).write.parquet(str(tmp_path / name))
        seen[name] = before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name != "rans":
            assert docs.columns == names
    rows = [(r.doc_id, r.text) for r in seen["jaccard_join"][0].collect()]
    firsts = {c for _, n, c in brute_components(rows) if n}
    assert {r.doc_id for r in seen["jaccard_join"][1].collect()} == firsts
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in seen["decontaminate"])
    for i, text in before.items():
        assert (i in after) == (not any(" ".join(b.split()) in " ".join(text.split()) for b in bench))
    mixed = seen["mixing"][1].collect()
    assert {r.doc_id for r in mixed} <= set(after)
    words = lambda rows: sum(base_counts(r.text)[0] for r in rows)
    assert words(mixed) == pytest.approx(1.5 * words(seen["mixing"][0].collect()), rel=0.2)
    tokens = seen["rans"][1].collect()
    assert sorted((r.doc_id, r.n_tokens) for r in tokens) == sorted((r.doc_id, len(ids_of(r.text))) for r in mixed)


def test_run_on_odd_and_empty_tables(spark, docs, tmp_path):
    """Null and repeated ids, empty and very long texts, clashing columns; and no rows at all."""
    import corpus_pipeline

    plain = [(100 + k, " ".join(f"{w}{k}" for w in ("some", "words", "that", "stand", "alone")) * 9, "en", "t") for k in range(5)]
    items = spark.createDataFrame([(1, "what is asked here today? the answer"), (2, None), (2, "")], "item_id long, text string")
    for name, rows in (("odd", [*ODD, *plain]), ("empty", [])):
        folder = tmp_path / name
        docs(rows, extra=True).write.parquet(str(folder / "documents.parquet"))
        items.write.parquet(str(folder / "benchmark.parquet"))
        got = corpus_pipeline.run(spark, str(folder)).collect()
        texts = {r[0]: r[1] for r in rows}
        assert {r.doc_id for r in got} <= set(texts)
        assert all(r.n_tokens == len(ids_of(texts[r.doc_id])) for r in got)
        assert {100 + k for k in range(5)} & {r.doc_id for r in got} if rows else not got
