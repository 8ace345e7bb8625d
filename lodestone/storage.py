"""The folder that driver and executors share."""
import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder only where it is unset in local mode."""
    sc = spark.sparkContext
    if d := sc.getConf().get("spark.checkpoint.dir"):
        return d.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _own:
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own[sc.applicationId] = "file://" + own
    return _own[sc.applicationId]
