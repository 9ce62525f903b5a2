"""The corpus pipeline, stage by stage, against SQL and plain versions on what the stage before it kept."""

import hashlib
import sys
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from cloudloom.llm import secrets  # noqa: E402
from cloudloom.llm.sql import NEAR_DUPLICATES, QUALITY  # noqa: E402

SF = "/root/testdata/sf0.001"


def answer(sql, docs):
    c = duckdb.connect()
    c.register("documents", docs)
    return c.execute(sql).to_arrow_table().to_pylist()


def test_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, states = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    states.append(docs.toArrow())
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        states.append(docs.toArrow())
        assert k == 4 or docs.columns == columns
    ids = [set(s.column("doc_id").to_pylist()) for s in states]
    assert ids[1] == {r["doc_id"] for r in answer(QUALITY, states[0]) if r["kept"]}
    assert ids[2] == {r["doc_id"] for r in answer(NEAR_DUPLICATES, states[1]) if r["doc_id"] == r["class_id"]}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids[3] == ids[2] - brute.contaminated([(r["doc_id"], r["text"]) for r in states[2].to_pylist()], items).keys()
    before = {r["doc_id"]: r["text"] for r in states[3].to_pylist()}
    net = secrets.default_net()
    after = {r["doc_id"]: r["text"] for r in states[4].to_pylist()}
    assert before.keys() == after.keys()
    for i, text in before.items():
        base = secrets.base_spans(text)
        assert after[i] == secrets.redact(text, base + secrets.model_spans([text], [base], net)[0])
        assert not [s for s in brute.secret_spans(after[i]) if s[1] != "assign"]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in states[5].to_pylist():
        found = t.encode(after[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == found
        assert (r["n_tokens"], r["ids_sha256"]) == (len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest())
    run = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in run.select("doc_id").collect()} == ids[5]


def test_stages_on_edge_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, one doc_id with two texts, columns that clash; then an empty table."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    good = " ".join(f"word{i}" for i in range(80))
    texts = [None, "", good, good, good + " more", "x" * 100_000, "same " * 90, good.replace("word", "w"), f"{good.replace(chr(119), chr(116))} token = abcdefgh1234", None, good.replace("word", "v")]
    rows = [(i if i < 9 else None, t, None, ["h1", None][i % 2], None if t is None else len(t)) for i, t in enumerate(texts)] + [(7, good.replace("word", "u"), "en", "h1", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_row", "_host", "_id", "_nth", "verdict", "rep", "key", "bucket", "label", "ids", "h", "class_id"):
        docs = docs.withColumn(c, F.lit(c))
    stages = corpus_pipeline.STAGES
    for frame, name in ((docs, "some"), (docs.limit(0), "none")):
        now = frame
        for k, (_, stage) in enumerate(stages):
            before = now.count()
            stage(spark, now, SF).write.parquet(f"{tmp_path}/{name}{k}")
            now = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert now.count() <= before and (k == 4 or now.columns == docs.columns)
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in now.select("doc_id").collect())
        # 0, 1, 5, 6 and the null text fail the rules; 3, 4 and one row of 7 are copies; the null doc_id stays
        assert ids == ([(False, 2), (False, 7), (False, 8), (True, 0)] if name == "some" else [])
    plain = docs.select("doc_id", "text")
    assert secrets.redacted(plain).columns == ["doc_id", "text"] and secrets.redacted(plain).count() == len(rows)
