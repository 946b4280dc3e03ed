import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_every_query_is_named_once_and_sql_belongs_to_one():
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "percentile" in out.columns


def test_the_rest_stands_without_the_training_data_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tidemark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "boards" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
