import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_names(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys() and len(e.queries()) > 170


def test_without_the_text_operators(tmp_path):
    """The entry module imports, and offers the other queries, where the text subpackage is absent."""
    for p in ("geoloom", "__spark_entry__.py"):
        (tmp_path / p).symlink_to(ROOT / p)
    code = "import sys; sys.modules['geoloom.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 160 and said[1] == "False"


def test_nothing_else_imports_the_text_operators():
    for p in (ROOT / "geoloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
