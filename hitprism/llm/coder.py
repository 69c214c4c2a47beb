"""Adaptive context-mixing range coder for token ids, many stretches at a time.

A frame's ids are cut into blocks of ``BLOCK`` ids. Each block starts from the
same empty model, has its own CRC-32 and can be decoded alone. A block is coded
as lanes of ``LANE`` consecutive ids, numpy lanes that run side by side: one step
codes one id of every lane by the block's model, which then learns all of them.

Model of a block, integers only, so that all machines agree:

- order 0: how often each id has come up in the block; tallied after 1, 2, 4, ...
  ids of a lane and from ``TALLY`` on after so many;
- order 1 and order 2: the id that followed the same one or two ids (order 2 by
  hashed slots), with a confidence that grows when it comes again;
- mixing: how often the one, the other or neither guess came true where both had
  these confidences; the guesses' weights beside order 0 are those odds.

The three are summed, so one step of the range coder codes an id. The guesses'
intervals come first; the rest of order 0 follows: a place for each id, then the
ids that have come up, in ascending order. So an id that has come up is found by
one look into the block's sorted ids, without a search. The coder
keeps 64 bits and writes words of 32 bits; it never needs a carry, since a
range that would straddle a word boundary is cut short there.
"""

import zlib

import numpy as np

LANE = 1024
BLOCK = 256 * LANE
IDS = 1 << 16
SLOTS = 1 << 18
LEVELS = 4  # of confidence; 0: no guess yet
STEP = 24
TALLY = 16
PARTS, MOST_ODDS = 64, 64
_U = np.uint64
_WORD, _MASK = _U(32), _U(0xFFFFFFFF)

# Both confidences, and whether both orders guess one id (order 2 then has no weight).
_PAIRS = LEVELS * LEVELS
_CASES = 2 * _PAIRS
_WEIGHS = np.zeros((2, _CASES), np.int64)
_WEIGHS[0, :_PAIRS] = _WEIGHS[0, _PAIRS:] = np.arange(_PAIRS) >= LEVELS
_WEIGHS[1, :_PAIRS] = np.arange(_PAIRS) % LEVELS > 0


def _halves(packed):
    """The upper and lower 32 bits of non-negative numbers."""
    return packed >> 32, packed & 0xFFFFFFFF


class _Model:
    """The models of all blocks of a frame, for lanes that stand in block order.

    The sum of weights stays below 2^30 (see ``BLOCK``, ``STEP``, ``MOST_ODDS``).
    ``search``: whether ids are to be found by their places.
    """

    def __init__(self, lanes, search):
        self.search = search
        self.block = np.arange(lanes) // (BLOCK // LANE)
        self.blocks = -(-lanes // (BLOCK // LANE))
        self.count = np.zeros(self.blocks * IDS, np.int32)
        # start and size of each id's interval by order 0, in the upper and lower 32 bits
        self.plain = np.tile(np.arange(IDS) << 32 | 1, self.blocks)
        self.known = np.zeros(0, np.int64)
        # places in the tables of the ids since the last tally; of those not known then
        self.recent, self.fresh, self.step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        # 4 * id + confidence
        self.guess = np.zeros(self.blocks * (IDS + SLOTS), np.int32)
        # per block and case: neither guess came true, order 1 did, order 2 did
        self.came = np.repeat([[2], [1], [1]], self.blocks * _CASES, axis=1)
        self.last = [np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)]
        self._tally()
        self._place()

    def _place(self):
        """Where each lane's block starts in the tables."""
        self.of_count = self.block * IDS
        self.of_slot = self.block * (IDS + SLOTS) + np.array([[0], [IDS]])
        self.of_case = self.block * _CASES
        self._share()

    def _share(self):
        self.base = (IDS + STEP * self.n).take(self.block)
        self.of_sorted = (np.cumsum(self.n) - self.n).take(self.block)

    def _tally(self):
        """Count the ids since the last tally, and place all that are known anew."""
        fresh = np.unique(np.concatenate(self.fresh))
        self.known = np.insert(self.known, self.known.searchsorted(fresh), fresh)
        np.add.at(self.count, np.concatenate(self.recent), np.int32(1))
        self.recent, self.fresh = [], [np.zeros(0, np.int64)]
        count = self.count.take(self.known).astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        bounds = ends[self.known.searchsorted(np.arange(self.blocks + 1) * IDS)]
        self.n = np.diff(bounds)
        before = ends[:-1] - bounds[self.known // IDS]
        self.plain[self.known] = (IDS + STEP * before) << 32 | STEP * count
        if self.search:
            # the ids that have come up, block by block, sorted; one more, so that there is one
            self.sorted = np.repeat(np.append(self.known % IDS, 0).astype(np.uint16), np.append(count, 1))
        part = np.repeat((IDS + STEP * self.n) // PARTS, _CASES)
        self.factor = np.tile(_WEIGHS, self.blocks) * part

    def drop_last(self):
        """The last lane has ended; the others go on."""
        self.block = self.block[:-1]
        self.last = [ids[:-1] for ids in self.last]
        self._place()

    def predict(self):
        """Guesses and their weights; returns the sum of all weights."""
        one, two = self.last
        hashed = (one * 0x9E3779B1 + two * 0x85EBCA77) >> 11
        hashed &= SLOTS - 1
        self.slot = self.of_slot.copy()
        self.slot[0] += one
        self.slot[1] += hashed
        self.entry = self.guess.take(self.slot)
        self.level = (self.entry & (LEVELS - 1)).astype(np.int8)
        self.ids = (self.entry >> 2).astype(np.int64)
        differ = self.ids[0] != self.ids[1]
        case = self.level[0] * np.int8(LEVELS)
        case += self.level[1]
        case += ~differ * np.int8(_PAIRS)
        self.case = self.of_case + case
        odds = np.minimum(self.came[1:] * PARTS // self.came[0], MOST_ODDS * PARTS) * self.factor
        first, second = _halves((odds[0] << 32 | odds[1]).take(self.case))
        total = first + second + self.base
        # what order 0 gives to the guesses; one guess of both orders is the first's alone
        self.start, self.size = _halves(self.plain.take(self.ids + self.of_count))
        self.size[1] *= differ
        self.first = first + self.size[0]
        self.second = second + self.size[1]
        self.both = self.first + self.second
        return total

    def _plain(self, ids):
        """Start and size of the ids' intervals by order 0 alone; the ids are taken down."""
        at = self.of_count + ids
        start, size = _halves(self.plain.take(at))
        self.recent.append(at)
        self.fresh.append(at[np.flatnonzero(size == 1)])
        return start, size

    def interval(self, ids):
        """Start and size of the ids' intervals."""
        self.true = self.ids == ids
        start, size = self._plain(ids)
        passed = self.size * (start > self.start)
        start += self.both - passed[0] - passed[1]
        one, two = self.true
        return (np.where(one, 0, np.where(two, self.first, start)),
                np.where(one, self.first, np.where(two, self.second, size)))

    def find(self, at):
        """The ids whose intervals hold the places ``at``; start and size of these."""
        guessed, one = at < self.both, at < self.first
        place = at - self.both
        # where the guesses' own intervals of order 0 stood, without the other one's
        gap = self.start - self.size[::-1] * (self.start > self.start[::-1])
        passed = self.size * (place >= gap)
        place += passed[0]
        place += passed[1]
        ids = self.sorted.take(self.of_sorted + (place - IDS) // STEP, mode="clip").astype(np.int64)
        fresh = np.flatnonzero(place < IDS)
        ids[fresh] = place[fresh]
        np.putmask(ids, guessed, self.ids[1])
        np.putmask(ids, one, self.ids[0])
        self.true = self.ids == ids
        start, size = self._plain(ids)
        start += at - place
        for of, at_start, at_size in ((guessed, self.first, self.second), (one, 0, self.first)):
            np.putmask(start, of, at_start)
            np.putmask(size, of, at_size)
        return ids, start, size

    def update(self, ids):
        self.step += 1
        # lanes of a block that meet in a slot: the last one's entry stays
        true = self.true.view(np.int8)
        kept = self.entry + (2 * true - 1 - (true & (self.level == LEVELS - 1)))
        self.guess[self.slot.reshape(-1)] = np.where(self.true | (self.level > 1), kept, (ids * LEVELS + 1).astype(np.int32)).reshape(-1)
        one, two = self.true & (self.level > 0)
        outcome = one.view(np.int8) + 2 * (two > one).view(np.int8)
        outcome = outcome * np.int64(self.came.shape[1]) + self.case
        self.came += np.bincount(outcome, minlength=self.came.size).reshape(self.came.shape)
        if self.step % TALLY == 0 or (self.step < TALLY and self.step & (self.step - 1) == 0):
            self._tally()
            self._share()
        self.last = [ids, self.last[0]]


def _settle(low, span):
    """Lanes that move on by a word, with ranges cut at word boundaries.

    A range of one whole word stays: moved on, its size would need 65 bits.
    """
    move = span < _U(1 << 32)
    return move, np.where(move, np.minimum(span, _U(1 << 32) - (low & _MASK)), span)


def _steps(lanes, last):
    """Numbers of the steps, and the lanes that take part; only the last lane is short."""
    for t in range(LANE if lanes > 1 else last):
        yield t, lanes if t < last else lanes - 1


def _moved(low, span):
    """Lanes that move on by a word, as numbers; these words. ``low`` and ``span`` are moved."""
    at = np.flatnonzero(span < _U(1 << 32))
    moving = low[at]
    span[at] = _settle(moving, span[at])[1] << _WORD
    low[at] = moving << _WORD
    return at, moving >> _WORD


def encode_lanes(ids, last):
    """Words of each row of ``ids`` (lanes x LANE), of whose last row ``last`` count,
    row after row, and how many each has."""
    lanes = len(ids)
    model = _Model(lanes, False)
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    columns = np.ascontiguousarray(ids.T, np.int32)
    ended, moved, words = [], [], []
    for t, n in _steps(lanes, last):
        if n < len(low):
            ended.append(low[-1:])
            low, span = low[:-1], span[:-1]
            model.drop_last()
        now = columns[t, :n].astype(np.int64)
        part = span // model.predict().view(_U)
        start, size = model.interval(now)
        low = low + part * start.view(_U)
        span = part * size.view(_U)
        at, done = _moved(low, span)
        moved.append(at)
        words.append(done)
        model.update(now)
    # the range holds a whole word's start, since it is no smaller than a word
    low = np.concatenate([low, *ended])
    of = np.concatenate([*moved, np.arange(lanes)]).astype(np.min_scalar_type(lanes))
    words = np.concatenate([*words, (low >> _WORD) + (low & _MASK != 0)]).astype(np.uint32)
    return words[np.argsort(of, kind="stable")], np.bincount(of, minlength=lanes)


def decode_lanes(words, last):
    """Reverse of ``encode_lanes``; ``words`` has a row of words per lane."""
    lanes = len(words)
    model = _Model(lanes, True)
    words = np.concatenate([words, np.zeros((lanes, 2), np.uint32)], axis=1)
    width = words.shape[1]
    words = words.astype(_U).reshape(-1)
    place = np.arange(lanes) * width
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    code = (words[place] << _WORD) | words[place + 1]
    ends = place + width - 1
    place += 2
    ids = np.zeros((LANE, lanes), np.int32)
    for t, n in _steps(lanes, last):
        if n < len(low):
            low, span, code = low[:-1], span[:-1], code[:-1]
            model.drop_last()
        total = model.predict()
        part = span // total.view(_U)
        at = np.minimum((code - low) // part, (total - 1).view(_U)).view(np.int64)
        now, start, size = model.find(at)
        ids[t, :n] = now
        low = low + part * start.view(_U)
        span = part * size.view(_U)
        moved, _ = _moved(low, span)
        read = place[moved]
        code[moved] = (code[moved] << _WORD) | words[np.minimum(read, ends[moved])]
        place[moved] = read + 1
        model.update(now)
    return ids.T


MAGIC = b"CMX3"


def _shape(n):
    """Numbers of blocks and of lanes, and the ids in the last lane."""
    lanes = -(-n // LANE)
    return -(-n // BLOCK), lanes, n - (lanes - 1) * LANE if lanes else 0


def _sums(ids):
    """The CRC-32 of each block's ids as little-endian 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    return np.array([zlib.crc32(raw[a : a + 4 * BLOCK]) for a in range(0, len(raw), 4 * BLOCK)], "<u4")


def pack(ids):
    """A frame's ids as bytes: magic, number of ids, the blocks' CRC-32, the
    lanes' numbers of words, and their words."""
    ids = np.ascontiguousarray(ids, "<i4")
    if len(ids) and (ids.min() < 0 or ids.max() >= IDS):
        raise ValueError("ids must be from 0 to 65535")
    _, lanes, last = _shape(len(ids))
    grid = np.zeros(lanes * LANE, np.int32)
    grid[: len(ids)] = ids
    words, n_words = encode_lanes(grid.reshape(lanes, LANE), last)
    head = MAGIC + np.array([len(ids)], "<u4").tobytes()
    return head + _sums(ids).tobytes() + n_words.astype("<u2").tobytes() + words.astype("<u4").tobytes()


def unpack(data):
    """The ids of a frame; raises ValueError where a block is damaged."""
    if data[:4] != MAGIC or len(data) < 8:
        raise ValueError("not a frame of coded ids")
    n = int(np.frombuffer(data, "<u4", 1, 4)[0])
    blocks, lanes, last = _shape(n)
    start = 8 + 4 * blocks + 2 * lanes
    if len(data) < start or (len(data) - start) % 4:
        raise ValueError("a frame of coded ids is cut short")
    sums = np.frombuffer(data, "<u4", blocks, 8)
    n_words = np.frombuffer(data, "<u2", lanes, 8 + 4 * blocks).astype(np.int64)
    used = np.frombuffer(data, "<u4", offset=start)
    if len(used) != n_words.sum():
        raise ValueError("a frame of coded ids is cut short")
    words = np.zeros((lanes, int(n_words.max(initial=0))), np.uint32)
    words[np.arange(words.shape[1]) < n_words[:, None]] = used
    ids = decode_lanes(words, last).reshape(-1)[:n]
    if (_sums(ids) != sums).any():
        raise ValueError("a block of coded ids is damaged")
    return ids
