import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from statewatch.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "6g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stream(spark):
    """Three keys, one with most of the rows; unordered, total order by t0."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for key, n in ((0, 150), (1, 21), (2, 5)):
        for t in range(n):
            rows.append((key, t, float(np.clip(rng.normal(0.1, 0.4), -1, 1)), [float(v) for v in rng.uniform(0, 1, 4)]))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, t0 int, s double, x array<double>").repartition(3).cache()


def by_key(df, value, t="t"):
    """{key: values in order}"""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["k"], r[t])):
        out.setdefault(r["k"], []).append(r[value])
    return out
