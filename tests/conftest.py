import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wildtally import schemas  # noqa: E402
from wildtally.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


MILLIS_2017_04_04 = 1491264000000
DAY = 86400000


@pytest.fixture(scope="session")
def records(spark):
    """A few occurrences: two archives, three days, repeated ids, nulls."""
    frog, duck, fly = "Animalia|Chordata|Amphibia|Anura|Rana", "Animalia|Chordata|Aves|Anas|Anas acuta", "Animalia|Insecta| Musca "
    t = MILLIS_2017_04_04
    rows = [
        (frog, 42.37, -71.11, 1, "a1", t, "gbif"),
        (frog, 42.37, -71.11, 1, "a1", t, "gbif"),
        (frog, 42.0, -71.0, 2, "a2", t + DAY, "idigbio"),
        (duck, 42.5, -70.5, 3, "b1", t + 2 * DAY + 5, "gbif"),
        (duck, 10.0, 20.0, 4, "b2", t, "inaturalist"),
        (fly, 42.1, -71.2, 5, "c1", t + DAY, "gbif"),
        (None, 42.2, -71.3, 6, "d1", t, "gbif"),
        (fly, None, -71.2, 7, "c2", t, "gbif"),
        (fly, 42.2, None, 8, None, t, "gbif"),
    ]
    return spark.createDataFrame(rows, schemas.OCCURRENCE)


@pytest.fixture(scope="session")
def traits(spark):
    rows = [("Anas", "mass", 900.0), ("Rana", "mass", 30.0), ("Rana", "mass", 40.0), ("Musca", "winged", None), ("Other", "mass", 5.0)]
    return spark.createDataFrame(rows, schemas.TRAIT)


def column(frame, name):
    return [row[name] for row in frame.collect()]
