import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def scanned():
    """A metric of the Parquet scans of a plan after it ran, the largest first."""

    def of(df, metric):
        df.collect()
        found = []

        def walk(plan):
            name = plan.nodeName()
            if name == "AdaptiveSparkPlan":
                return walk(plan.executedPlan())
            if name.endswith("QueryStage"):
                return walk(plan.plan())
            if name.startswith("Scan parquet"):
                found.append(plan.metrics().apply(metric).value())
            children = plan.children()
            for i in range(children.length()):
                walk(children.apply(i))

        walk(df._jdf.queryExecution().executedPlan())
        return sorted(found, reverse=True)

    return of
