"""The pipeline keeps, of its own stages' input, what brute force keeps."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.conftest import FOLDER
from tests.llm.test_matches import brute_components, brute_hits
from tests.llm.test_packing import check
from tests.llm.test_rows import brute_signals
from tracemill.llm import packing
from tracemill.llm.common import stage


def test_stages(spark_llm):
    docs = spark_llm.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark_llm.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "benchmark_decontamination", "packing"]
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        after = stage(function(spark_llm, docs, FOLDER), name)
        assert after.columns == docs.columns
        left = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "quality_rules":
            figures = {i: brute_signals(text) for i, text in before.items()}
            good = {i for i, f in figures.items() if f[0] >= 20 and 100 * f[4] <= 30 * f[0]}
            assert left == {i: before[i] for i in good}
        elif name == "line_dedup":
            assert set(left) == set(before) and 0 < sum(left[i] != before[i] for i in left)
            assert all(set(left[i].split("\n")) <= set(before[i].split("\n")) | {""} for i in left)
        elif name == "near_dedup":
            rows = sorted(before.items())
            want, _ = brute_components(rows)
            assert set(left) == {i for (i, _), first in zip(rows, want) if i == first}
        else:
            assert set(left) == {i for i, text in before.items() if not brute_hits(text, items)[3]}
        docs = after
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    want = {r["doc_id"]: [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 0] for r in docs.collect()}
    check(packing.pack(docs).collect(), want)


def test_run(spark_llm):
    out = corpus_pipeline.run(spark_llm, FOLDER)
    assert out.count() > 0 and "ids_crc32" in out.columns


def test_a_staged_table_leaves_no_shuffle_files(spark_llm):
    import glob
    import os
    import time

    local = spark_llm._jsc.sc().env().blockManager().diskBlockManager().localDirsString()

    def held():
        return sum(os.path.getsize(path) for folder in local for path in glob.glob(f"{folder}/*/shuffle_*.data"))

    before = held()
    dealt = spark_llm.range(300_000).repartition(4, "id")
    assert stage(dealt, "dealt").count() == stage(dealt, "dealt").count() == 300_000
    # Files go in the background.
    for _ in range(100):
        if held() <= before + 1_000_000:
            break
        time.sleep(0.1)
    assert held() <= before + 1_000_000
