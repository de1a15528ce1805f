"""The entry module with and without the training-data folder."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = """
import importlib.util, sys
sys.path.insert(0, {repo!r})
real = importlib.util.find_spec
importlib.util.find_spec = lambda name, *a: None if name == "amity.llm" else real(name, *a)
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert not any(n.startswith("op") or n == "pipeline" for n in names), sorted(names)
assert set(sql) <= set(names) and "common_friend_count" in names
"""


def test_entry_without_the_training_data_folder():
    subprocess.run([sys.executable, "-c", SCRIPT.format(repo=str(REPO))], check=True, cwd="/")


def test_every_oracle_has_a_query():
    import __spark_entry__ as e
    assert set(e.oracle_sql()) <= set(e.queries())
