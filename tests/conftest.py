import sys
from datetime import date
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortwise import fixed_values as fv  # noqa: E402
from cohortwise.schemas import raw_person_schema  # noqa: E402
from cohortwise.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


BLANK = dict.fromkeys(fv.PERSON_COLUMNS)
RESIDENT = {
    **BLANK,
    "cen_pr_flag": 1,
    "present_in_census": 1,
    "present_in_gpes": 1,
    "uresindpuk11_census": 1,
    "rgn_derived": "E12000007",
    "dob_census": date(1980, 5, 17),
    "sex_census": "1",
}


@pytest.fixture
def people(spark):
    """Raw persons from the fields in which they differ from a plain resident."""

    def make(*differences):
        rows = [tuple({**RESIDENT, **d}.values()) for d in differences]
        return spark.createDataFrame(rows, raw_person_schema())

    return make


@pytest.fixture
def column(spark):
    """Values of an expression over a one-column table."""

    def evaluate(values, type_name, expression):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {type_name}")
        return [r[0] for r in df.orderBy("i").select(expression).collect()]

    return evaluate
