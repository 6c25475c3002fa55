"""The entry points with and without the optional part."""

import os
import subprocess
import sys

import pytest
from conftest import ROOT

from headersieve.plans.queries import QUERIES

HIDE = """
import importlib.abc, sys
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name in {hidden!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""


@pytest.mark.parametrize("hidden", [["headersieve.llm"], ["xxhash", "pyarrow"], ["public_tokenizers"], ["corpus_pipeline"]])
def test_a_missing_part_takes_no_other_query_with_it(hidden):
    code = HIDE.format(hidden=hidden, root=ROOT)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(ROOT))
    assert done.returncode == 0, done.stderr
    found = int(done.stdout.split()[0])
    assert found >= len(QUERIES)
    if hidden == ["public_tokenizers"] and os.path.isdir(f"{ROOT}/headersieve/llm"):
        assert found > len(QUERIES)  # only the query that needs it fails, when it is run
