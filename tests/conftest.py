import pytest

from lintang.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def one(spark):
    """Evaluates a column function over literal values: one(fn, a, b) -> value."""
    from pyspark.sql import functions as F

    def run(fn, *values):
        names = [f"c{i}" for i in range(len(values))]
        schema = ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values))
        return spark.createDataFrame([values], schema).select(fn(*[F.col(n) for n in names]).alias("x")).first()["x"]

    return run
