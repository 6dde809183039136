"""Context-mixing range coder for token ids, in lockstep over many blocks.

Three models say what the next id is, and every bit of an id is coded by one of them:

- order 2, adaptive in each block: the id that followed the last two ids when they were last met there, by a hashed table with tags;
- order 1, of the whole segment: how often each id follows the last one, in a table that goes with the segment, and how often others do;
- order 0, of the whole segment: how often each id is one of those others.

The distribution of a step mixes them: order 2's id has an adaptive weight, which each block keeps for each confidence (how often in a row
the context's id was right) and learns from every id that has a candidate; the rest of the range has order 1's distribution, in which one place
leads on to order 0's, coded in a second step. A carry-less range coder (after Subbotin) with a window of 48 bits and words of 16 bits codes
the steps.

Every block is coded on its own from the same fresh state: the segment's tables, nothing in order 2, first weights. `encode` and `decode` take
all blocks at once, one lane of the arrays each; a turn of the loop codes one id of every block. All is reckoned in whole numbers.
"""

from __future__ import annotations

import numpy as np

#: Slots of order 2's table for each block, as a power of two.
SLOT_BITS = 10
#: A pair of ids that occurs less often has no place in order 1.
LEAST = 2
#: Places of a step, of an order-1 context at most, and of order 0 at least, as powers of two.
_BITS, _BITS1, _BITS0 = 20, 12, 18
_TOP, _BOT, _MASK = 1 << 32, 1 << 24, (1 << 48) - 1
_U = np.uint32
#: Weights of order 2 by confidence: at first, and what they move towards after a miss and after a hit. No candidate has confidence 0.
_FIRST = (np.array([0, 0.25, 0.6, 0.8, 0.9, 0.93, 0.95, 0.97]) * (1 << _BITS)).astype(np.int64)
_AFTER = np.array([0] + [1 << 12] * 7 + [0] + [(1 << _BITS) - (1 << 14)] * 7)
_RATE = 4
_NEXT = np.minimum(np.arange(8) + 1, 7)


class Tree:
    """The tables of orders 0 and 1. counts: how often order 0 gives each id; pairs: see `pairs_of`."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None):
        n = len(ids)
        self.ids = ids
        self.bits0 = max(_BITS0, int(n).bit_length() + 1)
        share = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        # Every id has one place, and the others go by the counts.
        self.first0 = np.arange(n + 1) + share * ((1 << self.bits0) - n) // max(1, int(share[-1]))
        self.first0[-1] = 1 << self.bits0
        self.of0 = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.first0))
        # Entries of all contexts in order; each one's first is the place that leads to order 0. The last context is that of a block's first id.
        self.listed, symbol, often, others = pairs if pairs else (np.zeros(n, np.int64), *[np.empty(0, np.int64)] * 2, np.ones(n, np.int64))
        size = np.append(self.listed + 1, 1)
        self.entry = np.cumsum(size) - size
        self.symbol, weight = np.full(int(size.sum()), n, np.int32), np.zeros(int(size.sum()), np.int64)
        own = np.ones(len(weight), bool)
        own[self.entry] = False
        self.symbol[own], weight[own] = symbol, often
        weight[self.entry] = np.append(others, 1)
        upto = np.cumsum(weight)
        before = upto - weight
        total = np.add.reduceat(weight, self.entry)
        self.bits = _bits(total)
        of = np.repeat(np.arange(n + 1), size)
        places, begun = np.int64(1) << self.bits[of], before[self.entry][of]
        first, end = (before - begun) * places // total[of], (upto - begun) * places // total[of]
        #: Of each entry its first place, the place after its last, and its id, in one number.
        self.span = (self.symbol.astype(np.int64) << 32) | (end << 16) | first
        self.place = np.cumsum(np.int64(1) << self.bits) - (np.int64(1) << self.bits)
        self.of = np.repeat(np.arange(len(weight), dtype=np.int32), end - first)


def _bits(total: np.ndarray) -> np.ndarray:
    """The places of contexts that occur so often, as powers of two."""
    return np.minimum(np.ceil(np.log2(np.maximum(total, 1))).astype(np.int64), _BITS1)


def pairs_of(table: np.ndarray, n: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """What order 1 lists, of rows of places in n ids, and how often order 0 then gives each id.

    The lists: for each id how many follow it in the table; these and how often each does; how often others do."""
    last, own = table[:, :-1].ravel().astype(np.int64), table[:, 1:].ravel()
    codes = np.sort(last * n + own)
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    codes, often = codes[first], np.diff(np.append(first, len(codes)))
    context, symbol = codes // n, codes % n
    total = np.bincount(context, often, n).astype(np.int64)
    # An entry has a whole place at least.
    keep = often >= np.maximum(LEAST, -(-2 * total // (1 << _BITS1)))[context]
    others = np.bincount(context[~keep], often[~keep], n).astype(np.int64)
    counts = np.bincount(symbol[~keep], often[~keep], n).astype(np.int64) + np.bincount(table[:, 0], minlength=n)
    others = np.where(others > 0, np.maximum(others, -(-2 * total // (1 << _BITS1))), 0)
    # A context without any list leads to order 0 at once.
    listed = np.bincount(context[keep], minlength=n)
    return (listed, symbol[keep], often[keep], np.where(listed > 0, others, 1)), counts


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct numbers in ascending order; the items in the order of their numbers; how many have each."""
    bits = len(codes).bit_length()
    if int(codes.max()).bit_length() + bits < 63:
        # Sorting numbers with their places takes a fraction of the time of sorting places.
        held = np.sort((codes << bits) | np.arange(len(codes)))
        order, codes = held & ((1 << bits) - 1), held >> bits
    else:
        order = np.argsort(codes)
        codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    return codes[first], order, np.diff(np.append(first, len(codes)))


def _context(last: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A hash of the numbers (from 1; 0: none) of the last two ids."""
    h = last * _U(0x9E3779B1)
    h += before * _U(0x85EBCA6B)
    h ^= h >> _U(15)
    h *= _U(0x2C1B3C6D)
    h ^= h >> _U(13)
    return h


class _Order2:
    """The contexts of two ids, for all lanes: tag, candidate (its number, from 1) and confidence in each slot."""

    def __init__(self, lanes: int):
        self.slots = np.zeros(lanes << SLOT_BITS, np.int64)
        self.base = np.arange(lanes, dtype=np.int64) << SLOT_BITS
        self.weights = np.tile(_FIRST, lanes)
        self.of = np.arange(lanes, dtype=np.int64) * 8

    def predict(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, weights) of the contexts; both are 0 where there is no candidate."""
        self.at = self.base + (h >> _U(32 - SLOT_BITS))
        self.tag = (h & _U((1 << 21) - 1)).astype(np.int64)
        self.tag += 1
        self.tag <<= 35
        held = self.slots.take(self.at)
        held ^= self.tag
        held *= held < 1 << 35
        self.sure = held & 7
        self.which = self.of + self.sure
        self.weight = self.weights.take(self.which)
        return held >> 3, self.weight

    def update(self, own: np.ndarray, hit: np.ndarray) -> None:
        """own: numbers of the ids, from 1."""
        moved = _AFTER.take(self.sure + (hit << 3))
        moved -= self.weight
        moved >>= _RATE
        moved += self.weight
        self.weights[self.which] = moved
        self.sure *= hit
        held = own << 3
        held |= self.tag
        held |= _NEXT.take(self.sure)
        self.slots[self.at] = held


def _due(low: np.ndarray, range_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(((low ^ (low + range_)) < _TOP) | (range_ < _BOT))


def _shifted(low: np.ndarray, range_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """After a word is out: low, range, and whether another one is due. A range across a carry is cut before it."""
    range_ = np.where((low ^ (low + range_)) < _TOP, range_, -low & (_BOT - 1)) << 16
    low = (low << 16) & _MASK
    return low, range_, ((low ^ (low + range_)) < _TOP) | (range_ < _BOT)


def encode(tree: Tree, table: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each row of places in tree.ids: the coder's words, and the number of its steps."""
    lanes, steps = table.shape
    n = len(tree.ids)
    # One turn's ids lie side by side.
    ids = np.ascontiguousarray(table.T.astype(np.int32))
    last = np.full((steps, lanes), n, np.int32)
    last[1:] = ids[:-1]
    # Where each id is in its context's list; those that are in none have the place that leads on.
    entry = tree.entry.take(last).astype(np.int32)
    if len(tree.symbol) > n + 1:
        context = np.repeat(np.arange(n + 1), np.append(tree.listed + 1, 1))
        codes = context * (n + 1) + tree.symbol
        # Lists ascend, but for the first of each, which comes last here.
        order = np.argsort(codes)
        codes = codes[order]
        own, item, often = _numbered(last.ravel() * np.int64(n + 1) + ids.ravel())
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        found = np.where(codes[at] == own, order[at], tree.entry[own // (n + 1)]).astype(np.int32)
        entry.ravel()[item] = np.repeat(found, often)
        del found, item, own
    onward = tree.symbol.take(entry) == n
    numbers = np.zeros((steps + 2, lanes), np.uint32)
    np.add(ids, 1, out=numbers[2:], casting="unsafe")
    contexts = _context(numbers[1:-1], numbers[:-2])
    bits_ = tree.bits.astype(np.uint8).take(last)
    del last, numbers
    model = _Order2(lanes)
    low, range_ = np.zeros(lanes, np.int64), np.full(lanes, _MASK, np.int64)
    out, to = np.zeros((2 * steps + 8) * lanes, np.uint16), np.arange(lanes, dtype=np.int64)
    # Words of all lanes lie by their number, then by lane; a step gives two at most, and few give any.
    count = np.zeros(lanes, np.int64)

    def put(go: np.ndarray) -> None:
        nonlocal out
        while len(go):
            if to.max() + lanes > len(out):
                out = np.concatenate((out, np.zeros_like(out)))
            a, b = low[go], range_[go]
            out[to[go]] = a >> 32
            to[go] += lanes
            low[go], range_[go], again = _shifted(a, b)
            go = go[again]

    for t in range(steps):
        own = ids[t].astype(np.int64) + 1
        candidate, weight = model.predict(contexts[t])
        hit = candidate == own
        rest, bits = (1 << _BITS) - weight, bits_[t]
        span = tree.span.take(entry[t])
        start = weight + (((span & 0xFFFF) * rest) >> bits)
        end = weight + ((((span >> 16) & 0xFFFF) * rest) >> bits)
        start[hit] = 0
        np.copyto(end, weight, where=hit)
        r = range_ >> _BITS
        low += r * start
        range_ = r * (end - start)
        on = np.flatnonzero(onward[t] & ~hit)
        if len(on):
            a, b = low[on], range_[on]
            put(on[_due(a, b)])
            x = own[on]
            r, start = range_[on] >> tree.bits0, tree.first0.take(x - 1)
            low[on] += r * start
            range_[on] = r * (tree.first0.take(x) - start)
            count[on] += 1
        put(_due(low, range_))
        model.update(own, hit)
    for shift in (32, 16, 0):
        if to.max() + lanes > len(out):
            out = np.concatenate((out, np.zeros_like(out)))
        out[to] = (low >> shift) & 0xFFFF
        to += lanes
    words = out.reshape(-1, lanes).T
    return [words[i, : to[i] // lanes].copy() for i in range(lanes)], count + steps


def decode(tree: Tree, words: list[np.ndarray], branches: np.ndarray, steps: int) -> np.ndarray:
    """The rows that `encode` took; ValueError if their steps are not as many."""
    lanes, n = len(words), len(tree.ids)
    model = _Order2(lanes)
    stream = np.concatenate([*words, np.zeros(4, np.uint16)])
    at = np.concatenate(([0], np.cumsum([len(w) for w in words])))[:-1]
    code = (stream[at].astype(np.int64) << 32) | (stream[at + 1].astype(np.int64) << 16) | stream[at + 2]
    at = at + 3
    end_ = len(stream) - 1
    low, range_ = np.zeros(lanes, np.int64), np.full(lanes, _MASK, np.int64)

    def taken(go: np.ndarray) -> None:
        while len(go):
            code[go] = ((code[go] << 16) & _MASK) | stream[np.minimum(at[go], end_)]
            at[go] += 1
            low[go], range_[go], again = _shifted(low[go], range_[go])
            go = go[again]

    out, count = np.empty((steps, lanes), np.int32), np.zeros(lanes, np.int64)
    last = np.full(lanes, n, np.int64)
    one = before = np.zeros(lanes, np.uint32)
    for t in range(steps):
        candidate, weight = model.predict(_context(one, before))
        r = range_ >> _BITS
        # Quotients of such numbers are never rounded up to a whole one.
        v = np.minimum(((code - low) / r).astype(np.int64), (1 << _BITS) - 1)
        hit = v < weight
        rest = (1 << _BITS) - weight
        bits = tree.bits.take(last)
        # The last place that begins at v or before it.
        place = ((((np.maximum(v - weight, 0) + 1) << bits) - 1) / rest).astype(np.int64)
        e = tree.of.take(tree.place.take(last) + place)
        span = tree.span.take(e)
        start = weight + (((span & 0xFFFF) * rest) >> bits)
        end = weight + ((((span >> 16) & 0xFFFF) * rest) >> bits)
        start[hit] = 0
        np.copyto(end, weight, where=hit)
        low += r * start
        range_ = r * (end - start)
        own = np.where(hit, candidate - 1, span >> 32)
        on = np.flatnonzero(own == n)
        if len(on):
            taken(on[_due(low[on], range_[on])])
            r = range_[on] >> tree.bits0
            x = tree.of0.take(np.minimum((code[on] - low[on]) // r, (1 << tree.bits0) - 1))
            start = tree.first0.take(x)
            low[on] += r * start
            range_[on] = r * (tree.first0.take(x + 1) - start)
            own[on] = x
            count[on] += 1
        taken(_due(low, range_))
        out[t] = last = own
        own = own + 1
        model.update(own, hit)
        before, one = one, own.astype(np.uint32)
    if (count + steps != branches).any():
        raise ValueError("steps of the blocks")
    return np.ascontiguousarray(out.T)
