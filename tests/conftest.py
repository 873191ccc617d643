import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")

from brookmart.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def feed(spark, tmp_path):
    """``feed(batches, schema)``: a stream that delivers one list of rows per micro-batch."""
    count = 0

    def build(batches, schema):
        nonlocal count
        count += 1
        folder = tmp_path / f"feed{count}"
        for i, rows in enumerate(batches):
            part = folder / f"part={i}"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
            for file in part.glob("*.parquet"):
                target = folder / f"{i:05d}.parquet"
                file.rename(target)
                os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
            for left in part.iterdir():
                left.unlink()
            part.rmdir()
        reader = spark.readStream.schema(spark.createDataFrame([], schema).schema)
        return reader.option("maxFilesPerTrigger", 1).parquet(str(folder))

    return build


@pytest.fixture
def drain(spark, tmp_path):
    """``drain(stream)``: run to the end of the input and return the rows written."""
    count = 0

    def run(stream, mode="append"):
        nonlocal count
        count += 1
        name = f"drained_{count}"
        query = (
            stream.writeStream.outputMode(mode).format("memory").queryName(name)
            .option("checkpointLocation", str(tmp_path / f"checkpoint{count}")).trigger(availableNow=True).start()
        )
        try:
            query.awaitTermination(180)
            assert not query.isActive and query.exception() is None
        finally:
            query.stop()
        run.query = query
        return spark.table(name).collect()

    return run
