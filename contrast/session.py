"""Session builder with the settings the operators are designed for."""

from pyspark.sql import SparkSession


def build_session(app_name="contrast", master=None, **conf):
    """A session with AQE, skew handling and UTC; ``conf`` overrides any setting.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
