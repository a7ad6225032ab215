"""Session defaults shared by tests, the bench and command-line use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "corpusloom", **more: str) -> SparkSession:
    """A local session in UTC with adaptive execution; a cluster supplies its own session instead. checkpoint_dir=x sets spark.checkpoint.dir."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config(map={f"spark.{k.replace('_', '.')}": v for k, v in more.items()})
        .getOrCreate()
    )
