import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tracemill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def tokens(spark):
    """Builds tokens from ``{(grp, trace_id): [ids]}``."""

    def build(traces):
        rows = [(g, t, i, int(s)) for (g, t), seq in traces.items() for i, s in enumerate(seq)]
        return spark.createDataFrame(rows, "grp long, trace_id long, pos long, sym_id int")

    return build
