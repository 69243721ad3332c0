import subprocess
import sys

from tests.conftest import ROOT


def test_imports_need_no_session():
    code = "import __spark_entry__ as e, boxmill.functions.pixels, boxmill.sources.readers, boxmill.streaming.ingest; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120).stdout.split()
    assert int(out[-2]) >= 60 and out[-1] == "True"


def test_entry_has_a_row_for_each_class(spark):
    import __spark_entry__

    assert sorted(r.cls for r in __spark_entry__.entry(spark).collect()) == [0, 1, 2, 3]
