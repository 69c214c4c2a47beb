"""The operators as queries over whole tables: ``(spark, folder) -> DataFrame``."""

import functools
import uuid

import public_tokenizers
from pyspark.sql import functions as F

from hitprism.llm import bpe, decontamination, linededup, lm, pii, quality, simhash, spelling, substrings, suffixes, tokenfile, urls, whitening
from hitprism.llm.stored import stored
from hitprism.plans.shared import shared_folder

URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
END_ID = 1
COMPONENTS = 4
PII_KEY = "pseudonyms of the query"


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@functools.lru_cache(1)
def byte_tokenizer():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.byte_tokenizer(ranks, public_tokenizers.PATTERN)


def url_filters(spark, folder):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return urls.filter_urls(pages, rules).drop("url")


def byte_bpe(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    # stored, so a task never has the workers of both steps at once
    ids = stored(bpe.encode(docs, byte_tokenizer()).select("doc_id", "ids"), "token-ids", bpe.BATCH_BYTES)
    return bpe.decode(ids, byte_tokenizer()).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"), "n_split")


def benchmark_decontamination(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.judged(docs, _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def simhash_near_dedup(spark, folder):
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    return found.withColumn("fingerprint", F.lpad(F.lower(F.hex("fingerprint")), 16, "0"))


def quality_rules(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                      "base_failed", "host_rejected", "kept")


def token_id_output(spark, folder):
    path = f"{shared_folder(spark)}/tables/token-file-{uuid.uuid4().hex}"
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        tokenizer = file.read()
    tokenfile.write_token_file(_table(spark, folder, "documents"), path, tokenizer, end_id=END_ID, apart=True)
    return tokenfile.read_token_file(spark, path, keep_ids=False).drop("ids")


def substring_dedup(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def pii_pseudonyms(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "n_found", "text")


def line_dedup(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def lm_scoring(spark, folder):
    return lm.score(_table(spark, folder, "documents"))


def embedding_whitening(spark, folder):
    found = whitening.whiten(_table(spark, folder, "embeddings").select("vec_id", "embedding"), "embedding", COMPONENTS)
    each = F.explode(F.arrays_zip(F.sequence(F.lit(1), F.size("whitened")).alias("component"), "whitened", "explained")).alias("c")
    return found.where(F.size("whitened") > 0).select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", "c.component", "n", "deviation", "c.whitened", "c.explained", "identity_error")


def spelling_variants(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return spelling.group_variants(spelling.document_words(docs))


def suffix_dedup(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries():
    return {
        "op1_url_filters": url_filters,
        "op2_byte_bpe": byte_bpe,
        "op3_benchmark_decontamination": benchmark_decontamination,
        "op4_simhash_near_dedup": simhash_near_dedup,
        "op5_quality_rules": quality_rules,
        "op6_token_id_output": token_id_output,
        "op7_substring_dedup": substring_dedup,
        "op8_pii_pseudonyms": pii_pseudonyms,
        "op9_line_dedup": line_dedup,
        "op10_lm_scoring": lm_scoring,
        "op11_embedding_whitening": embedding_whitening,
        "op12_spelling_variants": spelling_variants,
        "op13_suffix_dedup": suffix_dedup,
    }
