import os
import sys

import pytest

_HERE = os.path.dirname(os.path.abspath(__file__))
_ROOT = os.path.dirname(_HERE)
sys.path.insert(0, _ROOT)
# Python workers import test-module callables by name: put both folders on
# their path before the JVM (and so the workers) start.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [_ROOT, _HERE] + [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p])

from labelforge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app_name="labelforge-tests")
    yield s
    s.stop()


@pytest.fixture()
def tmp_dir(tmp_path):
    return str(tmp_path)
