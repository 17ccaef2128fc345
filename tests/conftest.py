import datetime as dt

import pytest

from vintagerisk.plans.session import local_session

FACT_TYPES = "cik string, source string, field string, period_end date, filed date, form string, fiscal_year int, value double, tag string"


@pytest.fixture(scope="session")
def spark():
    return local_session("4", "tests")


@pytest.fixture
def reported(spark):
    """Facts of a company: {(field, fiscal year): [(days from year end to filing, value[, tag]), ...]}."""

    def build(history, company="7310042"):
        rows = []
        for (field, year), versions in history.items():
            end = year if isinstance(year, dt.date) else dt.date(year, 12, 31)
            for lag, value, *tag in versions:
                filed = None if lag is None else end + dt.timedelta(days=lag)
                rows.append((company, "wire", field, end, filed, "20-F", end.year, None if value is None else float(value), tag[0] if tag else field.title()))
        return spark.createDataFrame(rows, FACT_TYPES)

    return build


@pytest.fixture
def observe(spark):
    def build(*days, company="7310042"):
        return spark.createDataFrame([(company, d) for d in days], "cik string, as_of date")

    return build
