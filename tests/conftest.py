import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from headersieve.session import build_session

    session = build_session(
        "headersieve-tests",
        "local[*]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def signatures(spark):
    from headersieve.sources.fixtures import seed_signatures
    from headersieve.sources.signatures import load_signatures

    return load_signatures(seed_signatures(spark))


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
