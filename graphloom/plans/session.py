"""Sessions: local ones for tests and benchmarks, and what every session needs before Python runs on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import graphloom


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors once per application, so that their Python finds it."""
    context = spark.sparkContext
    if getattr(context, "_graphloom_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(graphloom.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    context._graphloom_shipped = True


def local_session(cpus: int | str = 8, partitions: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """A ``local[cpus]`` session with the settings the tests and the benchmark use."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("graphloom")
    b = b.config("spark.sql.shuffle.partitions", str(partitions or cpus)).config("spark.driver.memory", memory)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
