import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from plotstats.plans.session import ADAPTIVE_CONF

    b = (SparkSession.builder.master("local[*]").appName("plotstats-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false"))
    for k, v in ADAPTIVE_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plotstats-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def frames(spark):
    """Build small survey tables with the declared schemas."""
    from plotstats.sources.schemas import SURVEY_SCHEMAS

    def make(name, rows, **defaults):
        schema = SURVEY_SCHEMAS[name]
        names = schema.fieldNames()
        full = []
        for r in rows:
            d = dict(defaults)
            d.update(r)
            full.append(tuple(d.get(n) for n in names))
        return spark.createDataFrame(full, schema)
    return make
