import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))


@pytest.fixture(scope="session")
def spark():
    from veilspan.session import local_session
    session = local_session(shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("veilspan.salt", "change-me")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def docs(spark):
    """Make a table of texts, numbered from 0, in one session."""
    def make(*texts, session="s"):
        return spark.createDataFrame([(i, session, t) for i, t in enumerate(texts)],
                                     "doc_id bigint, session_id string, text string")
    return make
