from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import tiktoken
from conftest import ROOT, TESTDATA
from oracle import connect, same_rows

import corpus_pipeline
from tidemark.llm import bpe, mixing, near_dup, quality
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import llm_queries


def test_queries_agree_with_their_sql(spark):
    con = connect(str(TESTDATA))
    for name, sql in ORACLES.items():
        same_rows(llm_queries()[name](spark, str(TESTDATA)), sql, con)


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(TESTDATA)).write.parquet(f"{tmp_path}/{len(held)}")
        docs = spark.read.parquet(f"{tmp_path}/{len(held)}")
        held[name] = docs
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    kept, single, clean, mixed, coded = (list(map(lambda r: r.asDict(), d.collect())) for d in held.values())

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    judged = {r["id"] for r in quality.judge_documents(spark.read.parquet(f"{TESTDATA}/documents.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in kept} == judged

    ids = {r["doc_id"] for r in single}
    bags = {r["doc_id"]: near_dup._counted(r["text"]) for r in kept}
    assert len(ids) == len(single)
    alike = [(a, b) for a in ids for b in ids if a < b and near_dup._similarity(bags[a], bags[b]) >= near_dup.SIMILARITY]
    assert alike == []
    gone = [i for i in bags if i not in ids]
    assert all(any(near_dup._similarity(bags[i], bags[j]) >= near_dup.SIMILARITY for j in bags if j < i) for i in gone)

    assert {r["doc_id"] for r in clean} == ids
    assert all(r["text"] == texts[r["doc_id"]] or "secret]" in r["text"] for r in clean)

    copies = {r["row"]["doc_id"]: r["copies"] for r in mixing.with_copies(held["secret scans"]).collect()}
    assert len(mixed) == sum(copies.values())

    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.BPE_RANKS))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    by_id = {r["doc_id"]: r["text"] for r in clean}
    assert sorted((r["doc_id"], r["n_tokens"]) for r in coded) == sorted((r["doc_id"], len(library.encode_ordinary(by_id[r["doc_id"]]))) for r in mixed)


def test_run_returns_the_last_stage(spark):
    assert corpus_pipeline.run(spark, str(TESTDATA)).columns[0] == "doc_id"


def test_the_rest_stands_without_this_part():
    """Nothing outside imports the subpackage, and the entry point imports without it."""
    for p in Path(ROOT, "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "tidemark.llm" not in p.read_text()
    code = "import pathlib; e = pathlib.Path.exists; pathlib.Path.exists = lambda p: p.name != 'corpus_pipeline.py' and e(p); import __spark_entry__ as x; assert not x.HAS_LLM and x.queries() and x.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_a_copy_without_this_part_passes(tmp_path):
    """Both folders and the pipeline deleted: the entry imports, queries and tests of the rest work."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    assert not (copy / "tidemark" / "llm").exists() and not (copy / "tests" / "llm").exists()
    code = "import __spark_entry__ as x; assert not x.HAS_LLM and set(x.oracle_sql()) <= set(x.queries()) and 'pipeline' not in x.queries()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
    subprocess.run([sys.executable, "-m", "pytest", "tests/test_codec.py", "-q"], cwd=copy, env=env, check=True, timeout=300)
