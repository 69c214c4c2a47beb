"""Arrow batches of texts as arrays of word codes.

Everything here works on one batch at a time, so a task's memory is bounded by
the batch size (``spark.sql.execution.arrow.maxBytesPerBatch``) or by one text
where a single text is larger.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hitprism.llm.shipping import ship

SLICE_BYTES = 4 << 20

_SAME = np.arange(256, dtype=np.uint8)

#: ASCII capitals become small letters.
LOWER = _SAME.copy()
LOWER[65:91] += 32


def text_slices(batch, column, most=SLICE_BYTES):
    """Consecutive rows of a batch whose texts hold ``most`` bytes together, or
    a single row with a longer text."""
    return slices(batch, pc.binary_length(batch.column(column)), most)


def slices(batch, sizes, most):
    """Consecutive rows of a batch whose sizes (null: 0) are ``most`` together, or a
    single larger row."""
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    row = 0
    while row < batch.num_rows:
        before = int(ends[row - 1]) if row else 0
        after = max(row + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(row, after - row)
        row = after


def byte_mapped(texts, table):
    """Texts with each byte replaced; ``table`` must keep bytes over 127."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    if data is None:
        return texts
    mapped = table[np.frombuffer(data, np.uint8)]
    return pa.Array.from_buffers(
        texts.type, len(texts), [None, offsets, pa.py_buffer(mapped)], offset=texts.offset
    )


class Words:
    """The words of each text: runs of anything but ASCII white space.

    ``codes``: the words' numbers in ``unique``; ``ends``/``starts``: where each
    text's words begin and end in ``codes``. A null text has no words.
    """

    def __init__(self, texts):
        parts = pc.ascii_split_whitespace(texts.fill_null(""))
        found = parts.flatten().dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        per_text = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        empty = pc.index(found.dictionary, pa.scalar("", found.dictionary.type)).as_py()
        if empty >= 0:
            real = codes != empty
            before = np.concatenate([[0], np.cumsum(real)])
            last = np.cumsum(per_text)
            per_text = before[last] - before[last - per_text]
            codes = codes[real]
        self.codes = codes
        self.unique = found.dictionary
        self.n = per_text
        self.ends = np.cumsum(per_text)
        self.starts = self.ends - per_text

    def text_of_word(self):
        """The number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.n)), self.n)

    def joined(self, keep=None):
        """The texts with one space between words, or between the words to
        ``keep``; and where each of these words starts and ends in all bytes."""
        codes, ends = self.codes, self.ends
        if keep is not None:
            codes, ends = codes[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
        words = self.unique.take(pa.array(codes))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), words)
        size = pc.binary_length(self.unique).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
        # a space after each word, but for the last word of each text before it
        filled = np.diff(ends, prepend=0) > 0
        texts_before = np.repeat((np.cumsum(filled) - filled), np.diff(ends, prepend=0))
        after = np.cumsum(size + 1) - 1 - texts_before
        return pc.binary_join(lists, " "), after - size, after


def per_text_sum(values, words):
    """Sums of a value per word over each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[words.ends] - total[words.starts]


def full_windows(words, size):
    """True at each word where a window of ``size`` words of one text starts."""
    last = np.repeat(words.ends, words.n) - size
    return np.arange(len(words.codes)) <= last


def covered(starts, size, n):
    """True at each of ``n`` places within ``size`` of a start at or before it."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + size, -1)
    return np.cumsum(steps[:-1]) > 0


def mixed(values):
    """Spread 64-bit values evenly (a bijection, with fixed odd factors)."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def window_hashes(values, size, factor):
    """Hash of each ``size`` consecutive 64-bit values, at every place; the
    last ``size - 1`` places wrap around and are not to be used."""
    out = np.zeros(len(values), np.uint64)
    for i in range(size):
        out = out * np.uint64(factor) + np.roll(values, -i)
    return mixed(out)


def sliding(values, size, pick):
    """``pick`` (np.minimum or np.maximum) over each ``size`` values from a place on;
    the last ``size - 1`` places hold less."""
    done, out = 1, values.copy()
    while done < size:
        step = min(done, size - done)
        out[:-step] = pick(out[:-step], out[step:])
        done += step
    return out


def map_batches(df, function, schema):
    """``function`` from one batch to an iterable of batches, over all of them."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return map_partitions(df, run, schema)


def map_partitions(df, function, schema):
    """``function`` from a partition's batches to an iterable of batches."""
    ship(df.sparkSession)

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()  # workers live on

    return df.mapInArrow(run, schema)
