import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_every_oracle_has_its_query():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100


def test_library_stands_alone(tmp_path):
    """Without the subpackage for training data and the pipeline the rest imports and keeps its queries."""
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "relevanta", tmp_path / "relevanta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = "import __spark_entry__ as e; q = e.queries(); assert 'ndcg_at_k' in q and not any(n.startswith('op') and n[2].isdigit() for n in q), q"
    subprocess.run([sys.executable, "-c", names], cwd=tmp_path, check=True, env={"PATH": ""})
