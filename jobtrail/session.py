"""Session settings the operators rely on, and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime options every operator assumes. Safe to call on a session owned by someone else."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session (tests, a laptop) may fall back to a temporary folder: on a cluster a
    machine-local path would be invisible to the other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="jobtrail-")
    return f"{root.rstrip('/')}/jobtrail/{name}-{uuid.uuid4().hex}"
