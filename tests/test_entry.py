"""The entry without its optional part, or without a library that only that part needs."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("blocked", ["tabletidy.llm", "corpus_pipeline", "ahocorasick"])
def test_entry_without(blocked):
    code = f"""
import sys, warnings
warnings.simplefilter("ignore")
sys.path.insert(0, {ROOT!r})
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == {blocked!r}:
            raise ModuleNotFoundError("blocked", name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as E
names = set(E.queries())
assert "a8_full_profile" in names and "entry" in dir(E)
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(E.oracle_sql()) <= names
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
