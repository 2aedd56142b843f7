"""The entry module with and without the removable corpus operators."""

import subprocess
import sys

import __spark_entry__ as entry
from conftest import ROOT

BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(('tessera.llm', 'corpus_pipeline')):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = e.queries()
assert 'take_weight_v2' in names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names
assert set(e.oracle_sql()) <= set(names)
"""


def test_entry_without_corpus_operators():
    subprocess.run([sys.executable, "-c", BLOCK], cwd=ROOT, check=True)


def test_entry_smoke(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    spark.catalog.clearCache()
