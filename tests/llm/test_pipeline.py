"""The pipeline's stages on a small corpus, each against a plain version of its decision."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tierwalk.llm import decontaminate, pii

DIR = "/root/testdata/sf0.01"  # the smallest with labels enough for a fit


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{DIR}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, DIR).write.parquet(at)
        out.append((name, docs, spark.read.parquet(at)))
        docs = out[-1][2]
    return out


def test_all_but_the_last_keep_the_columns(spark, stages):
    columns = spark.read.parquet(f"{DIR}/documents.parquet").columns
    assert [after.columns for _, _, after in stages[:-1]] == [columns] * 4
    assert stages[-1][2].select("doc_id").distinct().count() == stages[-2][2].count()


def test_quality_drops_junk_and_keeps_most(stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after.collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{DIR}/labels.parquet'").fetchall())
    good, bad = [i for i, v in labels.items() if v], [i for i, v in labels.items() if not v]
    assert sum(i in kept for i in good) >= 0.97 * len(good) and sum(i in kept for i in bad) <= 0.5 * len(bad)
    assert {r.doc_id: r.text for r in before.collect()}.items() >= {r.doc_id: r.text for r in after.collect()}.items()


def test_quality_keeps_what_scores_enough(spark, stages):
    from tierwalk.llm import quality
    from tierwalk.llm.common import held_out

    _, before, after = stages[0]
    model = quality.train(before, spark.read.parquet(f"{DIR}/labels.parquet"), ~held_out("doc_id", 5, 0))
    rows = before.collect()
    score = model.score(np.stack([quality.statistics((r.text or "").encode()) for r in rows]))
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r, x in zip(rows, score, strict=True) if x >= 0.3)


def test_packing_places_every_piece(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm.test_operators import check_packing

    _, before, after = stages[4]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in before.collect()}
    assert len(lengths) == before.count()
    n = check_packing(after.collect(), lengths, 2048)
    assert n <= -(-sum(lengths.values()) // 2048) * 1.01 + 1


def test_one_document_of_each_group_stays(stages):
    from tests.llm.test_operators import least_reachable, shingle_set

    _, before, after = stages[1]
    top = least_reachable({r.doc_id: shingle_set(r.text, 5) for r in before.collect()})
    assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, r in top.items() if i == r)


def test_no_benchmark_window_is_left(spark, stages):
    _, before, after = stages[2]
    found = decontaminate.find(after, spark.read.parquet(f"{DIR}/benchmark.parquet"))
    assert found.where("n_hit > 0").count() == 0
    assert after.count() >= 0.9 * before.count()


def test_no_base_span_is_left(stages):
    _, before, after = stages[3]
    assert before.count() == after.count()
    assert pii.find(after).where("exists(entities, x -> x.k < 4)").count() == 0
