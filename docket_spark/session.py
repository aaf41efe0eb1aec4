"""Session defaults and the one place where lineage is cut."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffle partitions and splits skewed join partitions at run time, so
# the static partition count only has to be an upper bound. UTC keeps date casts reproducible.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    app_name: str = "docket", master: str | None = None, extra: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(session: SparkSession, folder: str | None = None) -> str:
    """The shared folder for intermediate tables, set on the context if it is not yet.

    ``spark.checkpoint.dir`` names it; ``folder`` is used where that is unset. With neither, a local
    session takes a folder beside its warehouse, and a cluster session is refused, because a folder on
    one machine does not survive the loss of that machine.
    """
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        shared = session.conf.get("spark.checkpoint.dir", None) or folder
        if not shared:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            shared = session.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def cut_lineage(frame: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and continue from there."""
    checkpoint_folder(frame.sparkSession, folder)
    return frame.checkpoint(eager=True)
