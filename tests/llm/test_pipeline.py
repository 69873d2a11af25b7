"""The pipeline's stages against the operators' own decisions and brute force, on documents with planted cases."""

import pytest

import corpus_pipeline
from recallgrid.llm import quality
from recallgrid.llm.common import table


@pytest.fixture(scope="module")
def stages(spark, data):
    out, docs = {}, table(spark, data, "documents")
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, data))
        out[name] = docs
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmark", "tokens"]
    for name in ("quality", "lines", "near_copies", "benchmark"):
        assert stages[name].columns == stages["input"].columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_keeps_what_it_accepts(spark, data, stages):
    accepted = quality.predict(stages["input"].select("doc_id", "text"), quality.learned(spark, data)).where("predicted = 1")
    assert ids(stages["quality"]) == ids(accepted)


def test_lines_are_only_removed(stages):
    before = {r["doc_id"]: r["text"].split("\n") for r in stages["quality"].collect()}
    seen = set()
    for r in sorted(stages["lines"].collect(), key=lambda r: r["doc_id"]):
        own = r["text"].split("\n")
        it = iter(before[r["doc_id"]])
        assert all(x in it for x in own)  # in the same order
        for x in own:
            if x.split():
                assert tuple(x.split()) not in seen
                seen.add(tuple(x.split()))
        assert r["n_chars"] == len(r["text"]) or own == before[r["doc_id"]]


def test_no_near_copies_are_left(stages):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(r["text"]) for r in stages["near_copies"].collect()]
    for a in range(len(sets)):
        for b in range(a):
            assert not sets[a] or 100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b])
    assert ids(stages["near_copies"]) <= ids(stages["lines"])


def test_benchmark_passages_are_gone(spark, data, stages):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = set()
    for r in table(spark, data, "benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[i : i + 10]) in windows for w in [words(t)] for i in range(len(w) - 9))
    assert ids(stages["benchmark"]) == {r["doc_id"] for r in stages["near_copies"].collect() if not hit(r["text"])}


def test_tokens_of_all_that_is_left(stages):
    rows = stages["tokens"].collect()
    assert {r["doc_id"] for r in rows} == ids(stages["benchmark"]) and all(r["parity"] and r["round_trip"] and len(r["ids"]) == r["n_tokens"] for r in rows)


def test_run_is_the_stages(spark, data, stages):
    a = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, data).collect())
    assert a == sorted((r["doc_id"], r["n_tokens"]) for r in stages["tokens"].collect())


def test_entry_works_without_the_corpus_part(tmp_path):
    """With the subpackage, its tests and the pipeline gone, the other queries are still there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "recallgrid", tmp_path / "recallgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path).returncode == 0
