"""Steps kept as tables in the cluster's shared folder."""

from contextlib import contextmanager

from hitprism.plans.shared import shared_table

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def _set(spark, settings):
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stored(df, name, batch_bytes=None):
    """Write ``df`` in the shared folder and read it back.

    Lineage ends there, so a lost executor costs a reread only; the shuffle
    files behind the table are dropped as soon as it is written. ``batch_bytes``:
    of the Arrow batches that tasks get, instead of the session's.
    """
    with _set(df.sparkSession, {_CLEAN: "true"} | ({_BATCH: str(batch_bytes)} if batch_bytes else {})):
        return shared_table(df, name)
