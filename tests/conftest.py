import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
sys.path.insert(0, str(Path(__file__).parent))

from hitprism.schema import HITS
from hitprism.session import local_session

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def checkpoint_dir(tmp_path_factory):
    return tmp_path_factory.mktemp("shared")


@pytest.fixture(scope="session")
def spark(checkpoint_dir):
    settings = {"spark.checkpoint.dir": str(checkpoint_dir)}
    session = local_session(
        cores=4, shuffle_partitions=4, memory="4g", app="tests", settings=settings
    )
    yield session
    session.stop()


def at(text):
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def hits(spark):
    """Build a hits table from partial rows; columns not given are null."""

    def build(*rows):
        names = [f.name for f in HITS.fields]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], HITS)

    return build


@pytest.fixture(scope="session")
def star_hits(spark, tmp_path_factory):
    """The smallest data set's hits, written once."""
    from hitprism.sources.star import hits_from_star

    path = str(tmp_path_factory.mktemp("hits") / "hits")
    hits_from_star(spark, str(DATA)).write.parquet(path)
    return spark.read.schema(HITS).parquet(path)


def rows(df, *columns):
    """Rows as tuples, sorted; nulls first."""
    taken = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(taken, key=lambda t: [(v is not None, v) for v in t])
