"""Developer analytics on Spark: retrieval, memory, code quality and delivery metrics as DataFrame operators."""

import os
from pathlib import Path


def reach_workers(spark) -> None:
    """Let Python workers on this machine import the package wherever the session was started; clusters ship it with --py-files."""
    top = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if top not in known:
        environment["PYTHONPATH"] = os.pathsep.join([top, *filter(None, known)])
