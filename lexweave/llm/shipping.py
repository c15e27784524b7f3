"""Values handed to all tasks, whose classes need not be installed where the tasks run."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def shared(spark: SparkSession, value) -> Broadcast:
    """A broadcast of the value with its classes, which travel by value like the functions of this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(broadcast: Broadcast):
    return pickle.loads(broadcast.value)
