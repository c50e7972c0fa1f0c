import subprocess
import sys
from pathlib import Path


def test_names_and_oracles():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert names and set(entry.oracle_sql()) <= names


def test_names_are_known_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); import sparkorekta, sparkorekta.cli, sparkorekta.streaming.stream, sparkorekta.operators.hygiene, sparkorekta.operators.morphology"
    done = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
