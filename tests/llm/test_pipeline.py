"""The pipeline: stage by stage against brute force on a small corpus."""

import random

import pytest

import corpus_pipeline
from evidentia.llm.common import materialise

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), name)
        seen.append((name, docs))
    return dict(seen)


def test_columns_stay(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].columns == stages["input"].columns


def test_exact_stage(stages):
    before, after = stages["quality"].toPandas(), stages["exact"].toPandas()
    norm = before.text.fillna("").str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)
    assert sorted(after.doc_id) == sorted(before.groupby(norm).doc_id.min())


def test_near_stage(stages):
    from test_operators import _brute

    before, after = stages["exact"].toPandas(), stages["near"].toPandas()
    found = _brute(list(zip(before.doc_id, before.text)), 5, 80)
    assert sorted(after.doc_id) == sorted(i for i, (_, c) in found.items() if c == i)


def test_mix_stage(stages):
    before, after = stages["near"].toPandas(), stages["mix"].toPandas()
    assert set(after.doc_id) <= set(before.doc_id)
    assert after.groupby("doc_id").size().max() <= 2


def test_last_stage_decodes(stages):
    from evidentia.llm import pieces

    vocab = pieces.read_model()
    texts = dict(stages["mix"].select("doc_id", "text").collect())
    rows = stages["segment"].collect()
    assert all(vocab.decode(r.ids) == (texts[r.doc_id] or "") for r in random.Random(1).sample(rows, min(50, len(rows))))


def test_entry_lists_all_operators():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and ids, columns that clash, and no rows at all."""
    good = "The harbour office keeps a record of every boat that leaves before noon and of the people on board. "
    shape = "doc_id long, text string, lang string, source string, n_chars long, size long, key string, _digest string, places string, score double"
    text = lambda i: "".join(f"Line {i} {j} tells of place {i * 7 + j} and {good}\n" for j in range(6))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n\t", None, "s", 3), (None, text(9), "en", None, 5), (4, text(4), "en", "s", 1), (4, text(4), "en", "s", 1), (5, text(4), "en", None, 1), (6, text(6) * 60, "fr", "t", 1), (7, text(7), "en", "t", None)]
    docs = spark.createDataFrame([(*r, 1, "k", "d", "p", 0.5) for r in rows], shape)
    for start in (docs, docs.limit(0)):
        seen = materialise(start, "odd")
        for name, stage in corpus_pipeline.STAGES:
            after = materialise(stage(spark, seen, SF), name)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns
                before = {repr(tuple(r)) for r in seen.collect()}
                assert {repr(tuple(r)) for r in after.collect()} <= before, name  # no stage changes a row that it keeps
            seen = after
        assert (seen.count() > 0) == (start is docs)
    kept = {r.doc_id for r in corpus_pipeline.exact(spark, docs, SF).collect()}
    assert 5 not in kept and {4, 6, 7} <= kept
