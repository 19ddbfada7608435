import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_never_imports_the_optional_subpackage():
    code = "import sys; sys.modules['lexiforge.llm'] = None; import __spark_entry__ as e; assert 'p7_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT).returncode == 0
    for f in (ROOT / "lexiforge").rglob("*.py"):
        if "llm" not in f.parts:
            assert "lexiforge.llm" not in f.read_text(), f
