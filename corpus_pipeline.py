"""The corpus pipeline: five stages over ``documents``, each a table of its own.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All stages but the last keep the columns of ``docs``, also
those named like what a stage works out. Rows without an id are judged like others
but never dropped as near-duplicates. Rows that share an id count as one document.
A null text is empty. All stages take empty tables.
"""

from pyspark.sql import functions as F

from hitprism.llm import bpe, decontamination, linededup, quality, simhash
from hitprism.llm.queries import byte_tokenizer
from hitprism.llm.stored import stored


def _kept(docs, step):
    """The rows and columns of ``docs`` after a step that reads ids, texts and sources
    and adds columns of its own; what else ``docs`` has stays as it is, whatever its
    name, within one column that no step looks at."""
    read = [c for c in docs.columns if c in ("doc_id", "text", "source")]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in read]
    done = step(docs.select(*read, F.struct(F.lit(0).alias("_"), *rest).alias("_row")))
    return done.select(*[F.col(c) if c in read else F.col("_row").getField(c).alias(c) for c in docs.columns])


def quality_rules(spark, docs, sf_dir):
    """Drops documents that fail the rules, or whose host is rejected."""
    return _kept(docs, lambda own: quality.judge(own, keep_text=True).where("kept"))


def line_dedup(spark, docs, sf_dir):
    """Takes later occurrences of three-line windows out of the texts."""
    left = _kept(docs, linededup.dedup_lines)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the smallest id of each near-duplicate group."""
    kept = simhash.near_duplicates(docs).where("doc_id = component_id OR doc_id IS NULL").select("doc_id").distinct()
    return docs.join(kept.select(F.struct("doc_id").alias("_kept")), F.col("doc_id").eqNullSafe(F.col("_kept.doc_id")), "left_semi")


def benchmark_decontamination(spark, docs, sf_dir):
    """Drops documents that hold benchmark passages."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _kept(docs, lambda own: decontamination.judged(own, benchmark).where("NOT contaminated"))


def byte_bpe(spark, docs, sf_dir):
    """Encodes the texts and decodes the ids again; digests of both. The ids are stored
    between, so a task never has the workers of both steps at once."""
    ids = bpe.encode(docs.select("doc_id", "text"), byte_tokenizer()).select("doc_id", "ids")
    ids = stored(ids, "token-ids", bpe.BATCH_BYTES)
    return bpe.decode(ids, byte_tokenizer()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

# SimHash and BPE have no form in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in turn over ``documents``, each stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
