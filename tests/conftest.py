import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from symbolweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="symbolweave-tests-")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": folder})
    yield session
    session.stop()


@pytest.fixture
def make_graph(spark):
    """Nodes and edges out of short tuples."""
    from symbolweave.schema import EDGES, NODES

    def make(ids, links, kinds=None, parents=None):
        nodes = [
            (i, f"/{i}.py", f"name_{i}", (kinds or {}).get(i, "function"), f"def {i}()", n, n + 1,
             (parents or {}).get(i), "python", "{}")
            for n, i in enumerate(ids)
        ]
        edges = [(*(link if len(link) == 3 else (*link, "calls")), f"/{link[0]}.py", 1) for link in links]
        return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)

    return make
