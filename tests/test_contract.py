"""The driver's contract: names, SQL keys, and the library without its text subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).resolve().parent.parent


def test_keys():
    q, s = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(s) <= set(q) and {"p2_found", "p4_found", "p5_found", "p6_found", "top_customers"} <= set(q) and all(callable(f) for f in q.values())


def test_the_core_does_not_import_the_text_subpackage():
    code = "import sys; sys.modules['trellis.llm'] = None; import __spark_entry__ as e; assert 'p5_found' in e.queries() and not any(n.startswith('p8') for n in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
    assert not [p for p in (REPO / "trellis").rglob("*.py") if "llm" not in p.parts and "trellis.llm" in p.read_text()]
