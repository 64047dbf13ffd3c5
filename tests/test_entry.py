import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and len(df.columns) == len(set(df.columns))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_llm_folders(tmp_path):
    for name in ("lorewright", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "lorewright/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 100 and said[1] == "False"


def test_nothing_outside_llm_imports_it():
    for p in [*(ROOT / "lorewright").rglob("*.py"), *(ROOT / "tests").glob("*.py"), ROOT / "bench.py"]:
        if "llm" not in p.parts and p.name != "test_entry.py":
            assert "lorewright.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p
