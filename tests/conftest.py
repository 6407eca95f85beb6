from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from dipwatch import catalogs as C  # noqa: E402
from dipwatch.session import prepare  # noqa: E402
from tests.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return prepare(make_session())


@pytest.fixture(scope="session")
def coverage(spark):
    return C.coverage(spark)


@pytest.fixture(scope="session")
def catalog(spark):
    return C.decline_codes(spark)


@pytest.fixture(scope="session")
def merchants(spark):
    return C.merchants(spark)
