"""Intermediate results kept in the cluster's shared folder.

The folder is the one the session names in ``spark.checkpoint.dir``. Results
written there survive the loss of executors and cut the lineage, so nothing
upstream is computed twice and row placement is fixed from then on.
"""

import tempfile
import uuid

CHECKPOINT_DIR = "spark.checkpoint.dir"

# One scratch folder per local application, used only where none is named.
_local_folders = {}


def shared_folder(spark):
    """The shared folder of this session; a local one only on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        app = context.applicationId
        if app not in _local_folders:
            _local_folders[app] = tempfile.mkdtemp(prefix="hitprism-")
        folder = _local_folders[app]
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df):
    """Compute once, keep in the shared folder, partition by partition."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df, name):
    """Write as parquet in the shared folder and read it back.

    Unlike a checkpoint, readers of the table prune columns and push filters.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
