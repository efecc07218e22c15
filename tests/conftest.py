import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from gridloom.session import session

    top = tmp_path_factory.mktemp("spark")
    s = session(
        "local[4]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="4g", spark__sql__warehouse__dir=str(top / "warehouse"), spark__local__dir=str(top / "local")
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
