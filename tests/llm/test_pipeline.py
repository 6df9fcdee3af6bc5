"""The pipeline against plain versions of its deterministic stages."""

from collections import defaultdict

import corpus_pipeline
import pytest
from support import SF

from labelweave.llm import secrets
from labelweave.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    from test_brute import brute_classes

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = written(corpus_pipeline.drop_toxic(spark, docs, SF), "clean")
    assert clean.columns == COLUMNS and clean.count() > 0.8 * docs.count()
    single = written(corpus_pipeline.drop_copies(spark, clean, SF), "single")
    last = defaultdict(int)
    for r in clean.collect():
        last[r["text"] or ""] = max(last[r["text"] or ""], r["doc_id"])
    assert single.columns == COLUMNS and sorted(r["doc_id"] for r in single.collect()) == sorted(last.values())
    apart = written(corpus_pipeline.drop_near_copies(spark, single, SF), "apart")
    want = brute_classes([(r["doc_id"], r["text"]) for r in single.collect()])
    assert apart.columns == COLUMNS and sorted(r["doc_id"] for r in apart.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    masked = written(corpus_pipeline.mask_secrets(spark, apart, SF), "masked")
    before = {r["doc_id"]: r["text"] or "" for r in apart.collect()}
    assert masked.columns == COLUMNS and masked.count() == apart.count()
    for r in masked.collect():
        if secrets.scan_text(before[r["doc_id"]]):
            assert "[secret]" in r["text"] and r["n_chars"] == len(r["text"]) and not secrets.scan_text(r["text"])
        else:
            assert (r["text"] or "") == before[r["doc_id"]]
    packed = corpus_pipeline.pack(spark, masked, SF)
    assert packed.select("doc_id").distinct().count() == masked.count()


@pytest.mark.parametrize("stage", range(5))
def test_empty(spark, no_docs, stage):
    assert corpus_pipeline.STAGES[stage][1](spark, no_docs, SF).count() == 0
