"""The entry module without the corpus part, or with a part of it that can't be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys

class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ImportError(name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
found = e.queries()
assert "keyword_search" in found and "pipeline" not in found and not [q for q in found if q[:2] == "op" and q[2].isdigit()], sorted(found)[:5]
assert set(e.oracle_sql()) <= set(found)
print("good")
"""


@pytest.mark.parametrize("names", [["recallgrid.llm", "corpus_pipeline"], ["zstandard"], ["recallgrid.llm.topk_search"]])
def test_other_queries_work_without_the_corpus_part(names):
    done = subprocess.run([sys.executable, "-c", CODE.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "good", done.stderr[-800:]
