import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("rolecall-tests")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "6g")
         .config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "4")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a column over literal arguments: one(lambda a: f(a), 'x')."""
    def run(fn, *args):
        names = [f"c{i}" for i in range(len(args))]
        ddl = ", ".join(f"{n} {'bigint' if isinstance(a, int) and not isinstance(a, bool) else 'boolean' if isinstance(a, bool) else 'double' if isinstance(a, float) else 'array<string>' if isinstance(a, list) else 'string'}"
                        for n, a in zip(names, args))
        df = spark.createDataFrame([tuple(args)], ddl)
        v = df.select(fn(*[df[n] for n in names]).alias("v")).first()["v"]
        return v.asDict() if hasattr(v, "asDict") else v
    return run
