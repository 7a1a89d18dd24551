import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "lodestack", tmp_path / "lodestack", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "bench.py"):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert set(e.oracle_sql()) <= set(q) and len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    for with_pipeline in (False, True):
        if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
