"""The driver's entry module, also without the training-data subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(tmp_path, hide):
    """Names of queries() when the hidden modules cannot be imported, without a session."""
    code = f"""
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if any(name == h or name.startswith(h + '.') for h in {hide!r}):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries())
print(*e.queries())
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ROOT})
    assert run.returncode == 0, run.stderr
    return run.stdout.split()


def test_without_the_subpackage(tmp_path):
    found = names(tmp_path, ["tracewright.llm", "corpus_pipeline"])
    assert "alerts_summary" in found and "pipeline" not in found and not [n for n in found if n.startswith("op")]


def test_nothing_else_imports_it():
    for folder, _, files in os.walk(os.path.join(ROOT, "tracewright")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "llm" not in open(os.path.join(folder, f), encoding="utf-8").read(), f


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
