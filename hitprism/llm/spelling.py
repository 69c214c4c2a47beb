"""Grouping of spelling variants: words that differ by one code point.

Two words that differ by one inserted, deleted or replaced code point agree in one
of their halves. Words are dealt to shards by the first half and by the last half;
a word also goes where longer or shorter ones by one would look for it. A shard is
an index of its words, delimited, in both directions: suffix ranks of the text and of
the reversed text, moved together (``_Index``). Of each word the half is matched
exactly, from its outer end on, and extended across the other half up to the
delimiter with one error (``_Search``).

A shard has a bounded number of words: one that has more, as many words share a half,
is dealt as several indexes and blocks of words to look up.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hitprism.llm.shipping import ship
from hitprism.llm.stored import stored

RUN = r"[A-Za-zÀ-ÿ]+"
MODULUS = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Words of a shard, on average, and at most.
SHARD, MOST = 1 << 15, 1 << 17
#: Words looked up at once.
_BLOCK = 1 << 12
_STEP = 32
_DELIMITER = 1

_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_words(docs, doc_id="doc_id", text="text"):
    """Rows (word), one for each run of letters, lower-cased from A to Z. Where 97
    divides the CRC-32 of ``<doc_id>:<run>``, one code point of the run is missing,
    that at the CRC's remainder by its length. A null id is empty there."""
    runs = F.regexp_extract_all(F.translate(F.col(text), _CAPITALS, _SMALL), F.lit(RUN), 0)
    run = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) as int)), substring(run, cast(h % length(run) as int) + 2))")
    return run.select("run", crc.alias("h")).select(F.when(F.col("h") % MODULUS == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words, least_length=LEAST_LENGTH, least_count=LEAST_COUNT):
    """Rows (word, n): words of enough code points that occur often enough."""
    long_enough = words.where(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _suffix_ranks(text):
    """Places of a text's suffixes in order, by doubling prefixes."""
    n, width = len(text), 1
    rank = text.astype(np.int64)
    while True:
        later = np.full(n, -1, np.int64)
        later[:max(n - width, 0)] = rank[width:]
        key = rank * (rank.max() + 2) + later + 1
        order = np.argsort(key, kind="stable")
        fresh = np.diff(key[order], prepend=-1) != 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all() or width >= n:
            return order
        width *= 2


class _Ranks:
    """Of a transform: how often a symbol, or a smaller one, occurs before a place."""

    def __init__(self, transform, kinds):
        n = len(transform)
        blocks = n // _STEP + 1
        self.kinds, self.blocks = kinds, np.zeros((blocks, _STEP), transform.dtype)
        self.blocks.reshape(-1)[:n] = transform
        at = np.arange(n) // _STEP * kinds + transform
        counts = np.bincount(at, minlength=blocks * kinds).reshape(blocks, kinds)
        self.upto = np.zeros((blocks + 1, kinds), np.int32)
        np.cumsum(counts, axis=0, out=self.upto[1:])
        self.smaller = np.zeros((blocks + 1, kinds + 1), np.int32)
        np.cumsum(self.upto, axis=1, out=self.smaller[:, 1:])

    def _inside(self, places):
        block = places // _STEP
        rest = (places - block * _STEP).astype(np.uint8)
        return block, self.blocks[block], np.arange(_STEP, dtype=np.uint8) < rest[:, None]

    def before(self, places, symbols):
        """Occurrences of the symbol, and of smaller ones, before each place."""
        block, window, inside = self._inside(places)
        wanted = symbols.astype(window.dtype)[:, None]
        equal = ((window == wanted) & inside).sum(axis=1, dtype=np.uint8)
        less = ((window < wanted) & inside).sum(axis=1, dtype=np.uint8)
        return self.upto[block, symbols] + equal, self.smaller[block, symbols] + less

    def all_before(self, places):
        """Occurrences of every symbol before each place, a row for each."""
        block, window, inside = self._inside(places)
        own = (np.arange(len(places)) * self.kinds)[:, None] + window
        return self.upto[block] + np.bincount(own[inside], minlength=len(places) * self.kinds).reshape(-1, self.kinds)


class _Index:
    """Both directions of ``#word#word#...#``, each with an end (0) of its own.

    A state is an interval of suffix ranks in one direction and the first rank of the
    equal interval in the other. ``extend`` puts a symbol at one end of the pattern;
    the caller chooses the end by which of the two transforms it passes.
    """

    def __init__(self, text, kinds):
        self.kinds, self.size = kinds, len(text) + 1
        self.ranks = []
        for direction in (text, text[::-1]):
            direction = np.append(direction, direction.dtype.type(0))
            self.first = np.concatenate([[0], np.cumsum(np.bincount(direction, minlength=kinds))])
            order = _suffix_ranks(direction)
            if not self.ranks:
                self.order = order
            self.ranks.append(_Ranks(direction[order - 1], kinds))

    def extend(self, ranks, low, high, other, symbols):
        """The states with the symbol put in front, in the direction of ``ranks``."""
        equal, less = ranks.before(np.concatenate([low, high]), np.concatenate([symbols, symbols]))
        n = len(low)
        new_low, new_high = self.first[symbols] + equal[:n], self.first[symbols] + equal[n:]
        return new_low, new_high, other + less[n:] - less[:n]

    def branches(self, ranks, low, high, other):
        """All symbols that may be put in front: (state, symbol) and the new states."""
        n = len(low)
        counts = ranks.all_before(np.concatenate([low, high]))
        found = counts[n:] - counts[:n]
        state, symbol = np.nonzero(found)
        before = np.cumsum(found, axis=1) - found
        new_low = self.first[symbol] + counts[:n][state, symbol]
        return state, symbol, new_low, new_low + found[state, symbol], other[state] + before[state, symbol]


def _search(index, words, sizes, backwards):
    """Pairs (word, text place of a found word's first delimiter in rank order).

    ``words``: symbols of each word, padded; ``backwards``: the last half is exact
    and the first has the error, else the other way round. The pattern grows from
    the exact half's outer delimiter over the word to the other delimiter.
    """
    # growing to the right is putting in front in the reversed text
    ranks = index.ranks[0] if backwards else index.ranks[1]
    n = len(sizes)
    half = sizes // 2
    exact = sizes - half if backwards else half
    at = np.arange(n)

    def symbol(who, place):
        """The place-th symbol from the end that is matched first; then delimiters."""
        inside = place < sizes[who]
        column = np.where(inside, sizes[who] - 1 - place if backwards else place, 0)
        return np.where(inside, words[who, column], _DELIMITER)

    low, high, other = np.zeros(n, np.int64), np.full(n, index.size), np.zeros(n, np.int64)
    low, high, other = index.extend(ranks, low, high, other, np.full(n, _DELIMITER))
    place = 0
    while True:
        more = exact[at] > place
        if not more.any():
            break
        # words whose half has ended wait
        new = index.extend(ranks, low[more], high[more], other[more], symbol(at[more], place))
        low[more], high[more], other[more] = new
        left = high > low
        at, low, high, other = at[left], low[left], high[left], other[left]
        place += 1

    out = []

    def finish(who, place, low, high, other):
        """Exactly on to the delimiter."""
        while len(who):
            ended = place > sizes[who]
            out.append((who[ended], (low if backwards else other)[ended]))
            who, place, low, high, other = (x[~ended] for x in (who, place, low, high, other))
            low, high, other = index.extend(ranks, low, high, other, symbol(who, place))
            left = high > low
            who, place, low, high, other = who[left], place[left] + 1, low[left], high[left], other[left]

    # without an error so far: each symbol may be replaced, left out, or preceded by one more
    place = exact[at]
    while len(at):
        state, found, new_low, new_high, new_other = index.branches(ranks, low, high, other)
        own, place_of = at[state], place[state]
        wanted = symbol(own, place_of)
        real = found > _DELIMITER
        replaced = real & (found != wanted) & (place_of < sizes[own])
        finish(own[replaced], place_of[replaced] + 1, new_low[replaced], new_high[replaced], new_other[replaced])
        finish(own[real], place_of[real], new_low[real], new_high[real], new_other[real])
        skipped = place < sizes[at]
        finish(at[skipped], place[skipped] + 1, low[skipped], high[skipped], other[skipped])
        same = (found == wanted) & (place_of < sizes[own])
        at, place, low, high, other = own[same], place_of[same] + 1, new_low[same], new_high[same], new_other[same]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _points(words):
    """Words as rows of code points, padded with 0, and their sizes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.array(words, dtype=np.str_).view(np.uint32).reshape(len(words), -1)
    return points, sizes


def near_words(texts, n, asked, backwards):
    """Of the words ``asked``, those of ``texts`` (with counts ``n``) that differ by
    one code point, not in the exact half alone: arrays (asked, word, n of it)."""
    points, sizes = _points(texts)
    ask_points, ask_sizes = _points(asked)
    used = np.unique(np.concatenate([points.ravel(), ask_points.ravel(), [0]]))

    def code(x):
        return (np.searchsorted(used, x) + _DELIMITER).astype(np.uint8 if len(used) < 255 else np.uint16)

    # one row per word with a delimiter before it; the padding goes
    rows = np.concatenate([np.zeros((len(texts), 1), np.uint32), points], axis=1)
    text = code(rows[np.arange(rows.shape[1]) <= sizes[:, None]])
    index = _Index(np.append(text, text.dtype.type(_DELIMITER)), len(used) + 1)
    # ranks of suffixes that start with a delimiter, to the word after it
    starts = np.cumsum(sizes + 1) - sizes - 1
    word_at = np.searchsorted(starts, index.order)
    found = [[], []]
    for first in range(0, len(asked), _BLOCK):
        who, place = _search(index, code(ask_points[first:first + _BLOCK]).astype(np.int64), ask_sizes[first:first + _BLOCK], backwards)
        pair = np.unique(np.stack([who + first, word_at[place]]), axis=1)
        found[0].append(pair[0])
        found[1].append(pair[1])
    who, word = map(np.concatenate, found)
    return who, word, n[word]


def _half(length, from_end):
    """The half of a word that a word of this length matches exactly."""
    if from_end:
        return F.expr(f"right(word, cast(ceil(({length}) / 2) as int))")
    return F.expr(f"left(word, cast(floor(({length}) / 2) as int))")


def dealt(words, size=SHARD, most=MOST):
    """Rows (backwards, shard, index, block, asks, word, n): each word where it is to
    be found and, with ``asks``, where it is looked up.

    Shards that have more than ``most`` words are cut in indexes; the words looked up
    there are cut in blocks, each of which goes to all of the indexes.
    """
    total = words.count()
    shards = 1 + 4 * total // size
    copies = []
    for backwards in (False, True):
        own = _half("length(word)", backwards)
        keys = F.array_distinct(F.array(_half("length(word) - 1", backwards), own, _half("length(word) + 1", backwards)))
        each = words.select("word", "n", F.lit(backwards).alias("backwards"), own.alias("own"), F.explode(keys).alias("key"))
        copies.append(each.select("backwards", F.pmod(F.xxhash64("key", "backwards"), F.lit(shards)).alias("shard"),
                                  (F.col("key") == F.col("own")).alias("asks"), "word", "n"))
    placed = copies[0].union(copies[1]).groupBy("backwards", "shard", "word", "n").agg(F.bool_or("asks").alias("asks"))
    placed = stored(placed, "shard-words")
    large = placed.groupBy("backwards", "shard").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > most)
    large = large.select("backwards", "shard", F.ceil(F.col("words") / most).cast("int").alias("parts"))
    parts = placed.join(large, ["backwards", "shard"], "left").select(
        "backwards", "shard", "asks", "word", "n", F.coalesce("parts", F.lit(1)).alias("parts"))
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("parts") - 1)
    found = parts.select("backwards", "shard", part.alias("index"), F.explode(everywhere).alias("block"), F.lit(False).alias("asks"), "word", "n")
    asked = parts.where("asks").select("backwards", "shard", F.explode(everywhere).alias("index"), part.alias("block"), "asks", "word", "n")
    return found.union(asked)


def near_pairs(words, size=SHARD, most=MOST):
    """Rows (word, near, near_n): all words that differ from a word by one inserted,
    deleted or replaced code point. ``words``: distinct (word, n)."""
    ship(words.sparkSession)

    def run(group):
        asks = group.column("asks").to_numpy()
        texts, asked = (group.filter(pa.array(x)) for x in (~asks, asks))
        if not texts.num_rows or not asked.num_rows:
            return pa.table([pa.array([], kind) for kind in (pa.string(), pa.string(), pa.int64())], names=["word", "near", "near_n"])
        who, near, n = near_words(texts.column("word").to_pylist(), texts.column("n").to_numpy(), asked.column("word").to_pylist(),
                                  group.column("backwards")[0].as_py())
        return pa.table([asked.column("word").take(pa.array(who)), texts.column("word").take(pa.array(near)), pa.array(n)],
                        names=["word", "near", "near_n"])

    found = dealt(words, size, most).groupBy("backwards", "shard", "index", "block").applyInArrow(run, "word string, near string, near_n long")
    return found.distinct()


def _roots(forms):
    """Rows (word, root): the last word that forms lead to. A form's count is at
    least twice its word's, so steps are few; each round doubles their length."""
    now = stored(forms, "forms")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(now.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def group_variants(words, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, size=SHARD, most=MOST):
    """Per word: ``n``, ``n_near`` (words one code point away), ``form`` and ``form_n``
    (the near word that occurs most, if at least twice as often as the word; ties: the
    first in code-point order) and ``root`` (the last one that forms lead to).

    ``words``: a table with a column ``word``, a row for each occurrence; null words do
    not count, other columns are ignored. Words too short or too rare are left out. An
    empty table gives no rows.
    """
    known = stored(vocabulary(words.where("word IS NOT NULL").select("word"), least_length, least_count), "vocabulary")
    near = near_pairs(known, size, most)
    # the smallest of (-n, word) is the one of largest n, first in order
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    found = stored(known.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.n")).alias("near_n")), "near")
    is_form = F.coalesce(F.col("near_n") >= 2 * F.col("n"), F.lit(False))
    found = found.select("word", "n", "n_near", F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    roots = _roots(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
