"""The corpus pipeline, each stage against what its operator must do to its own input."""

import os
import re
import subprocess
import sys

import public_tokenizers as P

import corpus_pipeline
from tidemark.llm import bpe, mixing, quality, simhash
from tidemark.llm.queries import RANKS

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before, after = docs.collect(), out.collect()
        ids = sorted(r.doc_id for r in after)
        if k < 4:
            assert out.columns == docs.columns
        if name == "quality_classifier":
            assert ids == sorted(r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect())
        elif name == "simhash_near_dedup":
            groups = simhash.near_duplicates(docs).collect()
            assert ids == sorted({r.component_id for r in groups}) and len(ids) < len(before)
        elif name == "secret_scans":
            was = {r.doc_id: r.text for r in before}
            assert ids == sorted(was)
            for r in after:
                assert r.text == re.sub(r"[0-9a-f]{40}|[0-9A-F]{40}", "<secret>", was[r.doc_id]) and r.n_chars == len(r.text)
        elif name == "source_mix":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert ids == sorted(d for d, n in copies.items() for _ in range(n))
        else:
            with open(P.path(RANKS), "rb") as f:
                enc = bpe.encoder(f.read(), P.PATTERN)
            texts = {r.doc_id: r.text for r in before}
            assert len(after) == len(before)
            assert all(r.ids == enc.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in after)
        docs = out


def test_odd_documents_pass_every_stage(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "some words " * 20_000, "en", None, 1), (3, "b c", "en", "a", 3), (3, "b c", "en", "a", 3)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        assert "ids" in docs.columns


def test_the_rest_works_without_the_subpackage(tmp_path):
    for name in os.listdir(HERE):
        if name not in ("corpus_pipeline.py", ".git", "tidemark"):
            os.symlink(f"{HERE}/{name}", tmp_path / name)
    (tmp_path / "tidemark").mkdir()
    for name in os.listdir(f"{HERE}/tidemark"):
        if name != "llm":
            os.symlink(f"{HERE}/tidemark/{name}", tmp_path / "tidemark" / name)
    os.remove(tmp_path / "__spark_entry__.py")
    with open(f"{HERE}/__spark_entry__.py") as f:
        (tmp_path / "__spark_entry__.py").write_text(f.read())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 180 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
