"""Quality rules of documents and of the hosts they come from.

Each document is judged by rules on its own words and lines. Per host and rule
the share of failing documents is estimated and shrunk towards all hosts by a
beta prior fitted to them; a host over a limit loses its documents.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.llm.batches import Words, covered, full_windows, map_batches, per_text_sum, text_slices
from hitprism.llm.stored import stored

MIN_WORDS, WINDOW, MAX_REPEAT_PCT = 20, 8, 30
#: A host is rejected if more than this share of its documents, after
#: shrinking, fails one of the rules.
MAX_HOST_RATE = 0.5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

#: Rules whose failures are counted by host; the first two reject documents too.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repetitive": f"100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE_RULES = ["short", "repetitive"]


def _repeat_words(words):
    """Per text, its words in windows that occur twice or more in it."""
    whole = np.flatnonzero(full_windows(words, WINDOW))
    if not len(whole):
        return np.zeros(len(words.n), np.int64)
    ids = words.codes
    for step in (1, 2, 4):  # numbers of runs of 2, 4, 8 words; exact, not hashes
        pairs = (ids << 32) | np.roll(ids, -step)
        ids = np.unique(pairs, return_inverse=True)[1]
    keys = (words.text_of_word()[whole] << 32) | ids[whole]
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return per_text_sum(covered(whole[n[back] > 1], WINDOW, len(words.codes)), words)


def _dup_lines(texts):
    """Per text, the lines with a word, and those equal to an earlier line."""
    lines = pc.split_pattern(texts, "\n")
    per_text = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    found = lines.flatten().dictionary_encode()
    blank = pc.match_substring_regex(found.dictionary, r"^[\x20\x09-\x0D]*$").to_numpy(zero_copy_only=False)
    codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), per_text)[~blank[codes]]
    keys = np.unique((text << 32) | codes[~blank[codes]])
    n_lines = np.bincount(text, minlength=len(texts))
    return n_lines, n_lines - np.bincount(keys >> 32, minlength=len(texts))


def measure(docs, text="text"):
    """Add the columns of ``MEASURES`` (longs; a null text counts as empty)."""
    kept = [f for f in docs.schema.fields if f.name not in MEASURES]
    schema = T.StructType(kept + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batch):
        for rows in text_slices(batch, text):
            texts = rows.column(text).fill_null("")
            words = Words(texts)
            sizes = pc.utf8_length(words.unique).to_numpy(zero_copy_only=False).astype(np.int64)
            n_lines, n_dup = _dup_lines(texts)
            found = [words.n, per_text_sum(sizes[words.codes], words),
                     pc.count_substring_regex(texts, r"[#*$%&|<>]"), n_lines, n_dup, _repeat_words(words)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(f.name) for f in kept] + [pa.array(x).cast(pa.int64()) for x in found],
                names=schema.names)

    return map_batches(docs, run, schema)


def _beta_prior(mean, variance, inverse_n):
    """Alpha and beta by moments: the variance over hosts, less what chance
    adds to a share of few documents, is that of the hosts' true rates."""
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    chance = mean * (1 - mean) * inverse_n
    true = max(variance - chance, 1e-6)
    weight = min(max((mean * (1 - mean) - true) / true, 1.0), 1e4)
    return mean * weight, (1 - mean) * weight


def host_rates(measured, host):
    """One row per host: ``n_docs``, and per rule the shrunk rate of failures.

    ``measured`` should be a stored table: it is read twice, once for the prior
    (a few sums over hosts come to the driver). Documents without a host have
    no row.
    """
    fails = {r: F.coalesce(F.expr(c), F.lit(False)).cast("long") for r, c in RULES.items()}
    hosts = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), *[F.sum(c).alias(f"n_{r}") for r, c in fails.items()])
    share = {r: F.col(f"n_{r}") / F.col("n_docs") for r in RULES}
    sums = hosts.agg(
        F.avg(1 / F.col("n_docs")).alias("inverse_n"),
        *[F.avg(s).alias(f"mean_{r}") for r, s in share.items()],
        *[F.var_pop(s).alias(f"var_{r}") for r, s in share.items()]).first()
    rates = []
    for rule in RULES:
        alpha, beta = _beta_prior(sums[f"mean_{rule}"] or 0.0, sums[f"var_{rule}"] or 0.0, sums["inverse_n"] or 0.0)
        rates.append(((F.col(f"n_{rule}") + alpha) / (F.col("n_docs") + alpha + beta)).alias(f"{rule}_rate"))
    return hosts.select("host", "n_docs", *rates)


def judge(docs, host="source", text="text", keep_text=False, max_host_rate=MAX_HOST_RATE):
    """Add the measures, ``base_failed``, ``host_rejected`` and ``kept``.

    The measured rows are stored once, without the text unless ``keep_text``.
    Only rejected hosts are joined back. A document without a host is judged by
    its own rules only; repeated rows count as often as they occur and get the
    same verdict. Columns of the added names are replaced.
    """
    added = [*MEASURES, "base_failed", "host_rejected", "kept"]
    plain = docs.drop(*[c for c in added if c in docs.columns and c not in (host, text)])
    measured = measure(plain, text)
    measured = stored(measured if keep_text else measured.drop(text), "quality")
    over = [F.col(f"{r}_rate") > max_host_rate for r in RULES]
    rejected = host_rates(measured, host)
    for i, bad in enumerate(over):
        any_over = bad if not i else any_over | bad
    # built beside the other columns, so that no name of the table clashes
    rejected = stored(rejected.where(any_over).select(F.struct("host").alias("_rejected_host")), "rejected-hosts")
    base = F.expr(" OR ".join(f"({RULES[r]})" for r in BASE_RULES))
    return (
        measured.join(rejected, measured[host] == rejected["_rejected_host"]["host"], "left")
        .withColumn("base_failed", base)
        .withColumn("host_rejected", F.col("_rejected_host").isNotNull())
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .drop("_rejected_host")
    )
