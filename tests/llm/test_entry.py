"""The driver's entry with the corpus operators, in a process that has no session."""

from __future__ import annotations

import os
import subprocess
import sys

from strandwise.llm import queries
from strandwise.plans import catalog


def test_entry_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == [str(len(catalog.QUERIES) + len(queries.QUERIES) + 1), str(len(catalog.ORACLE_SQL) + len(queries.ORACLE_SQL))], done.stderr
