import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from assayer import local_session  # noqa: E402

EVENT = "cid long, ordinal long, step long, tag string, line long, main boolean, description string, file string"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def make_trace(spark):
    """Trace from (tag, line[, main[, description[, step]]]) tuples of one finding."""

    def build(*events, cid=1):
        rows = []
        for i, e in enumerate(events):
            tag, line, *rest = e
            main = rest[0] if rest else False
            text = rest[1] if len(rest) > 1 else ""
            step = rest[2] if len(rest) > 2 else i + 1
            rows.append((cid, i, step, tag, line, main, text, ""))
        return spark.createDataFrame(rows, EVENT)

    return build


@pytest.fixture
def make_findings(spark):
    def build(*rows):
        schema = "cid long, checker string, type string, severity string, file string, line long, function string, ordinal long"
        full = [(r[0], r[1], "", "High", r[2] if len(r) > 2 else "src/foo.c", r[3] if len(r) > 3 else 0, "f", i) for i, r in enumerate(rows)]
        return spark.createDataFrame(full, schema)

    return build
