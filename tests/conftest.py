import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from rolemill.plans.session import build_session

    session = build_session("tests", cores=8, shuffle_partitions=4,
                            shared_dir=tempfile.mkdtemp(prefix="rolemill-"))
    session.sparkContext.setLogLevel("ERROR")
    # Tiny inputs: compiling each stage would take longer than running it.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    session.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield session
    session.stop()
