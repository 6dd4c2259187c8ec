import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from awkward import documents, empty_documents
from haulage.llm import quality_classifier, source_mix
from haulage.llm.common import cut, table
from test_ngram_join import brute as brute_components
from test_suffix_decontamination import brute as brute_contamination
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_does_its_work_on_what_the_one_before_kept(spark):
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select(COLUMNS).collect()]
    scores = {r["doc_id"]: r["predicted"] for r in quality_classifier.score(docs, table(spark, SF, "labels")).collect()}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    plan = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if "mixing" in name:
            plan = {r["doc_id"]: r["copies"] for r in source_mix.mix_plan(docs).collect()}
        docs = cut(stage(spark, docs, SF), "test-stage")
        assert docs.columns == COLUMNS
        if "classifier" in name:
            rows = [r for r in rows if scores[r[0]] == 1]
        elif "Jaccard" in name:
            heads = {r[0] for r in brute_components(rows) if r[0] == r[2]}
            rows = [r for r in rows if r[0] in heads]
        elif "decontamination" in name:
            bad = {r[0] for r in brute_contamination(rows, items) if r[5]}
            rows = [r for r in rows if r[0] not in bad]
        else:
            rows = [r for r in rows for _ in range(plan[r[0]])]
        assert sorted(map(tuple, docs.collect())) == sorted(rows), name
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows):
        ids = tokens.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(map(tuple, last.select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == sorted(want)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, last.collect()))


def test_stages_on_awkward_and_empty_documents(spark):
    for docs in (documents(spark).select(COLUMNS), empty_documents(spark).select(COLUMNS)):
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, SF), "test-stage")
        docs.count()
