import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lodestone.llm.neardup import near_duplicates  # noqa: E402
from lodestone.llm.packing import default_path, encoder  # noqa: E402
from lodestone.llm.secrets import MASK  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, DATA).cache()
        seen[name] = (before.collect(), after.collect())
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    kept = {r["doc_id"] for r in seen["quality"][1]}
    assert len(bad & kept) <= 0.2 * len(bad) and len(set(text) - kept - bad) <= 0.25 * len(text)
    groups = {}
    for r in near_duplicates(spark.createDataFrame(seen["near_dedup"][0], docs.schema)).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    left = {r["doc_id"] for r in seen["near_dedup"][1]}
    assert all(len(g & left) == 1 for g in groups.values()) and len(left) == len(groups)
    masked = {r["doc_id"]: r for r in seen["secrets"][1]}
    assert set(masked) == left
    for i, r in masked.items():
        assert r["n_chars"] == len(r["text"]) and (r["text"] == text[i] or MASK in r["text"])
        assert "token = \"" not in r["text"] or MASK in r["text"]
    assert {r["doc_id"] for r in seen["mixing"][1]} == left
    exact, want = encoder(default_path()), []
    encode = lambda t: np.frombuffer(exact(t), dtype="<u4")
    for r in seen["mixing"][1]:
        ids = np.append(encode(r["text"]), 1).astype("<u4")
        want += [(r["doc_id"], s, zlib.crc32(ids[s : s + 2048].tobytes())) for s in range(0, len(ids), 2048)]
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in seen["packing"][1]) == sorted(want)


def test_run_gives_the_last_stage_rows(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
