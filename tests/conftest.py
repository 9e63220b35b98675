import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexiloom.session import build_session

    session = build_session(
        "lexiloom-tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def column(spark):
    """Evaluate a column function on a list of texts, in order."""
    from pyspark.sql import functions as F

    def run(function, texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        return [r[0] for r in rows.orderBy("i").select(function(F.col("text"))).collect()]

    return run


ENERGY = (
    "Harbour wind report\n\n"
    "Offshore turbines feed the harbour grid. The turbines stand in shallow water, and the grid operator pays for storage.\n\n"
    "Battery storage smooths the wind. Storage cells near the harbour were renewed twice! Were they cheap? No.\n\n"
    "Maintenance crews inspect turbine blades by drone. Drone images reveal cracks early, so blades last longer."
)
KITCHEN = (
    "Bread and patience\n\n"
    "Sourdough bread needs flour, water and patience. The baker folds the dough every hour.\n\n"
    "A hot oven gives the bread its crust. Steam keeps the crust thin while the dough rises."
)


@pytest.fixture(scope="session")
def library(spark):
    return spark.createDataFrame([(1, ENERGY), (2, KITCHEN), (3, ""), (4, "of the and"), (5, "short")], "doc_id long, text string")
