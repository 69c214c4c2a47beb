"""Byte-level BPE encoding and decoding with the tokenizers library.

A rank file holds byte strings; the library's BPE model works on characters.
So each byte stands for one printable character (``byte_characters``), texts are
encoded over that alphabet, and decoding reverses the table. Texts reach the
library in pieces that cannot change the result, each distinct piece of a
batch once, which bounds memory for texts of any length.
"""

import base64
import json
import os
import re
import sys
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.llm.batches import LOWER, map_partitions, slices, text_slices

SLICE_BYTES = 2 << 20
#: Ids decoded at once: a batch can have millions, each of which takes some 40 bytes.
SLICE_IDS = 1 << 19
#: Of the batches of texts where ids are stored; small, as each is in memory several times.
BATCH_BYTES = 8 << 20
#: Bytes of the pieces that a task remembers, with their ids; characters of the
#: longest of them; and characters that go to the library at once, whose results
#: take over a hundred bytes for each.
MOST_BYTES, MOST_LENGTH, AT_ONCE = 48 << 20, 128, 1 << 18

#: Pieces end before a space that no white space precedes: no match of a
#: pattern of this kind goes over that place, nor looks beyond it.
_PIECE_END = re.compile(r"(?<=\S)(?= )")
_SPACE_BEFORE_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "

# Letters that may be words of their own; both cases of all of them.
_WORD = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]{1,%d}" % MOST_LENGTH)
_LETTERS = "".join(c for c in map(chr, range(256)) if _WORD.match(c))

# ASCII white space as a space; 1 for ASCII letters, 2 for punctuation but "'".
_TO_SPACE = np.arange(256, dtype=np.uint8)
_TO_SPACE[9:14] = 32
_KIND = np.zeros(256, np.uint8)
_KIND[[b for b in range(128) if chr(b).isalpha()]] = 1
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = 2


@lru_cache(1)
def byte_characters():
    """The character of each byte: itself where it prints, else from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


def read_ranks(path):
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _last_merge(token, ranks):
    """The two parts that a token's own bytes end in before the last merge."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1),
                   key=lambda i: ranks.get(parts[i] + parts[i + 1], len(ranks)))
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


def byte_tokenizer(ranks, pattern):
    """The library's tokenizer, as JSON text, for the ranks of byte strings."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        if len(token) > 1:
            left, right = _last_merge(token, ranks)
            merges.append((shown[left], shown[right]))
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer.to_str()


def _lowers(tokenizer_json):
    """Whether a tokenizer makes small letters of capitals before all else."""
    first = json.loads(tokenizer_json)["normalizer"] or {}
    return any(n["type"] == "Lowercase" for n in first.get("normalizers", [first]) if n)


class Encoder:
    """Encodes Arrow arrays of texts; keeps the ids of short pieces it has seen, up
    to ``MOST_BYTES`` of them. A text that holds the literal of one of the tokenizer's
    added tokens, in any case, is one piece, so that the library sees it whole.

    ``spaces``: whether the vocabulary has tokens with white space. If not, the
    tokenizer drops it and pieces may end at any ASCII white space. ``apart``:
    no token holds a letter up to U+00FF beside ASCII punctuation other than ``'``, so
    pieces may end there too; only where ``spaces`` is false. A run of letters is
    then one word to the tokenizer: pieces of Latin letters alone go to the library's
    model at once, where its normalizer and its splitting leave such letters as they are.
    """

    def __init__(self, tokenizer_json, spaces=True, apart=False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.spaces, self.apart = spaces, apart
        added = [re.escape(t["content"]) for t in json.loads(tokenizer_json).get("added_tokens") or []]
        self.added = "|".join(added)
        self.lowers = _lowers(tokenizer_json)
        self.table = LOWER[_TO_SPACE] if self.lowers else _TO_SPACE
        self.shown = np.array([ord(c) for c in byte_characters()], "<u2")
        self.shown[32] = 32
        self.words = apart and self._leaves_letters()
        self.clear()

    def _leaves_letters(self):
        """Whether the tokenizer does nothing to Latin letters but make them small and
        show their bytes, and no added token is one of their words."""
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if splitter is None or any(_WORD.fullmatch(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()):
            return False
        small = _LETTERS.lower() if self.lowers else _LETTERS
        letters = normalizer.normalize_str(_LETTERS) if normalizer else _LETTERS
        return letters == small and [word for word, _ in splitter.pre_tokenize_str(small)] == self._shown([_LETTERS])

    def _shown(self, words):
        """The words as the model sees them, a character for each byte."""
        joined = " ".join(words)
        data = (joined.lower() if self.lowers else joined).encode()
        return self.shown[np.frombuffer(data, np.uint8)].tobytes().decode("utf-16-le").split(" ")

    def clear(self):
        """Forget all pieces."""
        self.slots, self.bytes = {}, 0
        self.flat, self.ends = np.zeros(1 << 10, np.int32), np.zeros(1 << 10, np.int64)
        self.again = np.zeros(1 << 10, bool)

    def shrink(self):
        """Forget the pieces that have not come up again since they were remembered, or
        since the last call; all of them where the others take over half of the room."""
        n = len(self.slots)
        kept = self.again[:n]
        pieces, sizes = list(compress(self.slots, kept)), np.diff(self.ends[: n + 1])
        flat = self.flat[: self.ends[n]][np.repeat(kept, sizes)]
        self.clear()
        self._remember(pieces, flat, sizes[kept])
        if self.bytes > MOST_BYTES // 2:
            self.clear()

    def _ids(self, pieces):
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _ids_of_words(self, words):
        tokenize = self.tokenizer.model.tokenize
        return [[token.id for token in tokenize(word)] for word in self._shown(words)]

    def _encoded(self, pieces, ids_of):
        """Ids of pieces in one array, and how many each has."""
        sizes, flat = np.zeros(len(pieces), np.int64), [np.zeros(0, np.int32)]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        row = 0
        while row < len(pieces):
            before = int(ends[row - 1]) if row else 0
            until = max(row + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
            found = ids_of(pieces[row:until])
            sizes[row:until] = np.fromiter(map(len, found), np.int64, len(found))
            flat.append(np.fromiter(chain.from_iterable(found), np.int32, int(sizes[row:until].sum())))
            row = until
        return np.concatenate(flat), sizes

    def _fit(self, n):
        while n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])

    def _remember(self, pieces, flat, sizes):
        """Keep the ids of the short ones; the arrays grow by doubling."""
        short = np.fromiter(map(len, pieces), np.int64, len(pieces)) <= MOST_LENGTH
        flat, sizes = flat[np.repeat(short, sizes)], sizes[short]
        pieces = pieces if short.all() else [pieces[i] for i in np.flatnonzero(short).tolist()]
        n, start = len(self.slots), int(self.ends[len(self.slots)])
        while n + len(pieces) >= len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self._fit(start + len(flat))
        self.flat[start : start + len(flat)] = flat
        self.ends[n + 1 : n + 1 + len(pieces)] = start + np.cumsum(sizes)
        self.slots.update(zip(pieces, range(n, n + len(pieces))))
        # the texts, their places in the dictionary, and the ids
        self.bytes += sum(map(sys.getsizeof, pieces)) + 108 * len(pieces) + 4 * len(flat)

    def _pieces(self, texts):
        """The pieces of all texts, and how many each text has; joined, those of
        a text have the same ids as the text."""
        if not self.spaces:
            texts = self._spaced(texts)
        lists = pc.split_pattern(texts, " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten()
        if not self.spaces:
            return values, sizes
        first = np.zeros(len(values), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        values = pc.if_else(pa.array(first), values, pc.binary_join_element_wise("", values, " "))
        odd = pc.match_substring_regex(texts, _SPACE_BEFORE_SPACE)
        if pc.any(odd).as_py():
            values, sizes = self._with_odd(texts, odd, values, sizes)
        return values, sizes

    def _spaced(self, texts):
        """The texts with a plain space wherever a piece may end."""
        _, offsets, data = texts.buffers()
        if data is None:
            return texts
        wide = pa.types.is_large_string(texts.type)
        ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
        text = self.table[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
        ends = ends - ends[0]
        if self.apart:
            kind = _KIND[text]
            lead = np.flatnonzero(text == 0xC3)  # of two bytes, all letters but two
            lead = lead[(text[lead + 1] & 0xDF) != 0x97]
            kind[lead] = kind[lead + 1] = 1
            at = np.flatnonzero(kind[1:] + kind[:-1] == 3) + 1
            text, ends = np.insert(text, at, 32), ends + np.searchsorted(at, ends)
        return pa.Array.from_buffers(
            pa.large_string(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])

    @staticmethod
    def _with_odd(texts, odd, values, sizes):
        """Cut texts with white space before a space by the rule itself."""
        ends = np.cumsum(sizes)
        parts, new_sizes, done = [], sizes.copy(), 0
        for row in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            own = _PIECE_END.split(texts[int(row)].as_py())
            parts += [values.slice(done, int(ends[row] - sizes[row]) - done), pa.array(own, values.type)]
            new_sizes[row], done = len(own), int(ends[row])
        return pa.concat_arrays([*parts, values.slice(done)]), new_sizes

    def __call__(self, texts):
        """Ids of all texts in one array, and how many each text has."""
        values, sizes = self._pieces_and_whole(texts.fill_null(""))
        found = values.dictionary_encode()
        unique = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        if self.bytes > MOST_BYTES:
            self.shrink()
        slot = np.fromiter(map(self.slots.get, unique, repeat(-1)), np.int64, len(unique))
        fresh = np.flatnonzero(slot < 0)
        self.again[slot[slot >= 0]] = True
        pieces = [unique[i] for i in fresh.tolist()]
        word = np.zeros(len(pieces), bool)
        if self.words:
            word = np.fromiter(map(bool, map(_WORD.fullmatch, pieces)), bool, len(pieces))
        words, others = list(compress(pieces, word)), list(compress(pieces, ~word))
        fresh, pieces = np.concatenate([fresh[word], fresh[~word]]), words + others
        found_ids = self._encoded(words, self._ids_of_words), self._encoded(others, self._ids)
        flat, new_sizes = (np.concatenate(both) for both in zip(*found_ids))
        # where the ids of each distinct piece are: among those known, then the new ones
        known = int(self.ends[len(self.slots)])
        start, size = self.ends[slot], self.ends[slot + 1] - self.ends[slot]
        start[fresh], size[fresh] = known + np.cumsum(new_sizes) - new_sizes, new_sizes
        codes = found.indices.to_numpy(zero_copy_only=False)
        lengths = size[codes]
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(start[codes] - total[:-1], lengths) + np.arange(total[-1])
        self._fit(known + len(flat))
        self.flat[known : known + len(flat)] = flat
        ids = self.flat[at]
        self._remember(pieces, flat, new_sizes)
        ends = np.cumsum(sizes)
        return ids, total[ends] - total[ends - sizes]

    def _pieces_and_whole(self, texts):
        """``_pieces``, but one piece for a text with the literal of an added token."""
        whole = pc.match_substring_regex(texts, self.added, ignore_case=True).to_numpy(zero_copy_only=False) if self.added else np.zeros(0, bool)
        if not whole.any():
            return self._pieces(texts)
        parts, sizes, row = [], [], 0
        for at in [*np.flatnonzero(whole).tolist(), len(texts)]:
            values, n = self._pieces(texts.slice(row, at - row))
            parts.append(values.cast(texts.type))
            sizes.append(n)
            if at < len(texts):
                parts.append(texts.slice(at, 1))
                sizes.append(np.ones(1, np.int64))
            row = at + 1
        return pa.concat_arrays(parts), np.concatenate(sizes)


@lru_cache(2)
def _encoder(tokenizer_json, spaces, apart=False):
    return Encoder(tokenizer_json, spaces, apart)


def byte_tokens(tokenizer_json):
    """The bytes of each id, by the reversed byte table; null where there is no such id."""
    from tokenizers import Tokenizer

    back = {c: b for b, c in enumerate(byte_characters())}
    ids = Tokenizer.from_str(tokenizer_json).get_vocab()
    tokens = [None] * (max(ids.values(), default=-1) + 1)
    for shown, number in ids.items():
        tokens[number] = bytes(back[c] for c in shown)
    return tokens


class ByteTable:
    """``byte_tokens`` for whole arrays of ids. Tasks get the tokens' bytes, as a
    tokenizer of their own would take some 80 MB in each."""

    def __init__(self, tokens):
        self.tokens = pa.array(tokens, pa.large_binary())

    def spans(self, ids, sizes):
        """Bytes of all texts, where each token ends in them, and text ends."""
        taken = self.tokens.take(pa.array(ids, pa.int32()))
        if taken.null_count:
            raise ValueError("an id is not in the vocabulary")
        offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1]
        data = np.frombuffer(taken.buffers()[2], np.uint8) if len(ids) else np.zeros(0, np.uint8)
        return data, offsets, offsets[np.concatenate([[0], np.cumsum(sizes)])]


def character_offsets(data, offsets, ends, sizes):
    """First and last-plus-one character of each token within its text.

    A token that holds part of a character spans the whole of it, so tokens
    that share a split character overlap there.
    """
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = np.repeat(leads[ends[:-1]], sizes)
    start, stop = offsets[:-1], offsets[1:]
    return (leads[np.minimum(start + 1, len(data))] - 1 - base).astype(np.int32), (leads[stop] - base).astype(np.int32)


def encode(docs, tokenizer_json, text="text", offsets=False):
    """Add ``ids`` (array of int) to each row; with ``offsets`` also
    ``starts`` and ``ends``, the tokens' characters in the text.

    A null or empty text has no ids. Columns of these names are replaced; other
    columns stay as they are, rows too (repeated rows are encoded alike).
    """
    names = ["ids", "starts", "ends"] if offsets else ["ids"]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + [T.StructField(n, T.ArrayType(T.IntegerType(), False)) for n in names])
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(tokenizer_json)
    tokens = context.broadcast(byte_tokens(tokenizer_json)) if offsets else None

    def encoded(rows, encoder, table):
        ids, sizes = encoder(rows.column(text))
        lists = [ids]
        if offsets:
            data, at, ends = table.spans(ids, sizes)
            lists += character_offsets(data, at, ends, sizes)
        where = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        columns = [rows.column(f.name) for f in kept]
        columns += [pa.ListArray.from_arrays(where, pa.array(x, pa.int32())) for x in lists]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches):
        encoder = _encoder(shared.value, True)
        table = ByteTable(tokens.value) if offsets else None
        for batch in batches:
            for rows in text_slices(batch, text, SLICE_BYTES):
                yield encoded(rows, encoder, table)
        encoder.clear()  # the worker goes on to other tasks

    return map_partitions(docs, run, schema)


def decode(docs, tokenizer_json, ids="ids"):
    """Add ``decoded`` (the bytes of a row's ids) and ``n_split``, the places
    between two tokens that lie inside a character.

    Whole rows give back the text's UTF-8 bytes. ``decoded_text`` makes text of
    them, also where ids were cut inside a character. Null or no ids give no
    bytes; an id that the vocabulary lacks fails the query.
    """
    names = ["decoded", "n_split"]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + [T.StructField("decoded", T.BinaryType()), T.StructField("n_split", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(byte_tokens(tokenizer_json))

    def decoded(rows, table):
        column = rows.column(ids)
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = column.flatten().to_numpy(zero_copy_only=False)
        data, offsets, ends = table.spans(found, sizes)
        inside = np.zeros(len(offsets), np.int64)
        middle = offsets < len(data)
        inside[middle] = (data[offsets[middle]] & 0xC0) == 0x80
        before = np.concatenate([[0], np.cumsum(inside)])
        last = np.cumsum(sizes)
        # of the places before each token, the one before a row's first is no place between two
        n_split = before[last] - before[np.minimum(last - sizes + 1, last)]
        decoded = pa.Array.from_buffers(
            pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]
        )
        columns = [rows.column(f.name) for f in kept] + [decoded.cast(pa.binary()), pa.array(n_split)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    def run(batches):
        table = ByteTable(shared.value)
        for batch in batches:
            for rows in slices(batch, pc.list_value_length(batch.column(ids)), SLICE_IDS):
                yield decoded(rows, table)

    return map_partitions(docs, run, schema)


def decoded_text(column):
    """Bytes as text; what is left of a character at a cut becomes U+FFFD."""
    return F.make_valid_utf8(column.cast("string"))
