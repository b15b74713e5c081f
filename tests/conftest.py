import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "2",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": "file://" + str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def simple_org(spark):
    rows = [("E001", None), ("E010", "E001"), ("E100", "E010"), ("E101", "E010"), ("E1000", "E100"), ("E1001", "E100"), ("E1010", "E101")]
    return spark.createDataFrame(rows, "employee_id string, supervisor_id string")


@pytest.fixture
def simple_edges(simple_org):
    return simple_org.where("supervisor_id is not null").selectExpr("employee_id as src", "supervisor_id as dst")
