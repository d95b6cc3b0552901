import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from scholiast.runtime import build_session, ship

    s = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """A folder of tables given as (name, rows, schema); missing ones are empty copies of the test data's."""

    def make(**given):
        root = tmp_path_factory.mktemp("tables")
        for name in os.listdir("/root/testdata/sf0.001"):
            short = name.removesuffix(".parquet")
            like = spark.read.parquet(f"/root/testdata/sf0.001/{name}")
            if short in given:
                rows, schema = given[short]
                df = spark.createDataFrame(rows, schema)
                for f in like.schema:
                    if f.name not in df.columns:
                        df = df.selectExpr("*", f"cast(null as {f.dataType.simpleString()}) as `{f.name}`")
            else:
                df = like.limit(0)
            df.write.parquet(f"{root}/{name}")
        return str(root)

    return make
