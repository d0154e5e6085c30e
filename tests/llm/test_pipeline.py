"""The pipeline's stages against plain versions, and its run as a whole."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from sheaf.llm.scratch import stash

    out = [("documents", spark.read.parquet(f"{SF}/documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, stash(stage(spark, out[-1][1], SF), name)))
    return dict(out)


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_columns(stages):
    names = list(stages.values())
    assert all(x.columns == names[0].columns for x in names[1:-1])
    assert all(r.n_chars == len(r.text) for r in stages["pii"].collect())


def test_toxic_documents_go(stages):
    left = {i for i, _ in rows(stages["toxicity"])}
    gone = [t for i, t in rows(stages["documents"]) if i not in left]
    assert 0 < len(gone) < 0.2 * len(left)


def test_one_of_each_group(stages):
    want = plain.near_duplicates(rows(stages["toxicity"]), 5)
    assert {i for i, _ in rows(stages["near_dedup"])} == {i for i, (_, c) in want.items() if i == c}


def test_no_benchmark_is_left(spark, stages):
    items = rows(spark.read.parquet(f"{SF}/benchmark.parquet").withColumnRenamed("item_id", "doc_id"))
    before, after = plain.contamination(rows(stages["near_dedup"]), items), plain.contamination(rows(stages["decontamination"]), items)
    assert all(n[1] == 0 for n in after.values())
    assert set(after) == {i for i, n in before.items() if not n[4]}


def test_no_personal_data_is_left(stages):
    assert all(plain.base_spans(t) == "" for _, t in rows(stages["pii"]))


def test_ids(stages):
    from sheaf.llm import bpe, queries

    with open(queries.tokenizer_file(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    texts = dict(rows(stages["pii"]))
    for r in stages["bpe"].limit(40).collect():
        want = codec.tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want) and r.decoded_sha256 == plain.sha(codec.decode(want))
    assert stages["bpe"].count() == len(texts)
