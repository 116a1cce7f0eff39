"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks of ``BLOCK``; every block starts from the same state and has a CRC-32 of its ids, so a damaged
block is noticed and the others stay readable, alone or together (``decode_blocks``); the record's table of frequencies,
which all its blocks need, has the checksum of its own zlib stream. In a block, each id is predicted by three orders:

* order 2 and order 1: the id that last followed the two ids, or the one id, before it, with a count of how often it held;
* order 0: the id frequencies of the record that the block lies in, sent ahead.

Whether the order-2 candidate is right, then whether the order-1 candidate is, are binary events; their probability is a
logistic mix of adaptive estimates from all three orders, with weights that learn after each event. An id that neither
gives is coded by order 0. All blocks of a record advance together, one id a step, as numpy lanes; arithmetic is on
integers only, so that decoding repeats encoding bit for bit. ``idcoder.java`` holds the same coder for whole records;
the two change together.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
SLOTS_LOG = 11
SLOTS = 1 << SLOTS_LOG
EVENT_LOG, ORDER0_LOG = 12, 18
RATE = 4
MAGIC = b"IDR1"
_BOTTOM = np.uint64(1 << 32)
_TOP_SHIFT, _WORD = np.uint64(48), np.uint64(16)

#: stretch(p) = ln(p / (1 - p)) of a 12-bit p, and its inverse, both in steps of 1 / 256.
_P = (np.arange(4096) + 0.5) / 4096
STRETCH = np.round(np.log(_P / (1 - _P)) * 256).astype(np.int64)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2304, 2305) / 256))), 32, 4064).astype(np.int64)


class OrderZero:
    """Frequencies of a record's ids, scaled to sum to 2**ORDER0_LOG with at least 1 each."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        self.ids, self.counts = ids.astype(np.int64), counts.astype(np.int64)
        total, room = max(1, int(counts.sum())), (1 << ORDER0_LOG) - len(ids)
        freq = 1 + self.counts * room // total
        if len(freq):
            freq[int(np.argmax(freq))] += (1 << ORDER0_LOG) - int(freq.sum())
        self.freq, self.cum = freq, np.cumsum(freq) - freq
        self.rank = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
        self.rank[self.ids] = np.arange(len(ids))
        #: of any id: the logarithm of its frequency, as an order-0 context of the events
        self.level = np.zeros(1 << 16, np.int64)
        self.level[self.ids] = np.minimum(15, np.log2(freq).astype(np.int64)) if len(freq) else 0

    def symbols(self) -> np.ndarray:
        """Place under the cumulative frequencies to the id."""
        return np.repeat(self.ids, self.freq)


class Lanes:
    """The adaptive state of all blocks of a record."""

    def __init__(self, n: int, zero: OrderZero):
        self.zero = zero
        self.base = np.arange(n) * SLOTS
        self.guess = [np.zeros(n * SLOTS, np.uint16) for _ in range(2)]  # by order 1 and order 2
        self.count = [np.zeros(n * SLOTS, np.uint8) for _ in range(2)]
        self.last = np.zeros((2, n), np.int64)
        # per event kind (order-2 candidate, order-1 candidate): estimates by input, in 16 bits, and mixing weights
        self.rate = np.full((2, 3, n * 16), 1 << 15, np.int64)
        self.weight = np.full((2, 3, n), 22_000, np.int64)
        self.at16 = np.arange(n) * 16

    def contexts(self, m: int) -> None:
        """Slots, candidates and counts of the first m lanes."""
        a, b = self.last[0, :m], self.last[1, :m]
        one = (a * 40503 & 0xFFFF) >> (16 - SLOTS_LOG)
        two = ((a * 0x9E3779B1 + b * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - SLOTS_LOG)
        self.slot = (self.base[:m] + one, self.base[:m] + two)
        self.cand = [g[s].astype(np.int64) for g, s in zip(self.guess, self.slot, strict=True)]
        self.held = [c[s].astype(np.int64) for c, s in zip(self.count, self.slot, strict=True)]

    def mix(self, kind: int, lanes: np.ndarray) -> np.ndarray:
        """12-bit probability that the candidate of the event is right."""
        one, two = self.held[0][lanes], self.held[1][lanes]
        candidate = self.cand[1 - kind][lanes]
        agree = (self.cand[0][lanes] == self.cand[1][lanes]).astype(np.int64)
        at = self.at16[lanes]
        self.inputs = (at + two, at + one + 8 * agree, at + self.zero.level[candidate])
        rate, weight = self.rate[kind], self.weight[kind]
        self.stretched = [STRETCH[rate[k][x] >> 4] for k, x in enumerate(self.inputs)]
        total = sum(weight[k][lanes] * s for k, s in enumerate(self.stretched)) >> 16
        self.p = SQUASH[np.clip(total, -2304, 2304) + 2304]
        return self.p

    def learn(self, kind: int, lanes: np.ndarray, right: np.ndarray) -> None:
        rate, weight = self.rate[kind], self.weight[kind]
        error = (right << 12) - self.p
        for k, x in enumerate(self.inputs):
            old = rate[k][x]
            rate[k][x] = old + (((right * 65535) - old) >> RATE)
            weight[k][lanes] += (self.stretched[k] * error + (1 << 9)) >> 10

    def advance(self, m: int, ids: np.ndarray) -> None:
        """Take the ids in: candidates that held gain, others lose or are replaced."""
        for k in range(2):
            held, right = self.held[k], self.cand[k] == ids
            gone = ~right & (held <= 1)
            slot = self.slot[k]
            self.count[k][slot] = np.where(gone, 1, np.where(right, np.minimum(held + 1, 7), held >> 1))
            self.guess[k][slot] = np.where(gone, ids, self.cand[k])
        self.last[1, :m] = self.last[0, :m]
        self.last[0, :m] = ids


class Encoder:
    def __init__(self, n: int, steps: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.words, self.size = np.zeros((n, 2 * steps + 8), np.uint16), np.zeros(n, np.int64)

    def put(self, lanes: np.ndarray, cum: np.ndarray, freq: np.ndarray, log: int) -> None:
        r = self.range[lanes] >> np.uint64(log)
        self.low[lanes] += r * cum.astype(np.uint64)
        self.range[lanes] = r * freq.astype(np.uint64)

    def settle(self, m: int) -> None:
        """Shift words out until each range is wide enough for the next id."""
        lanes = np.arange(m)
        while len(lanes):
            low, wide = self.low[lanes], self.range[lanes]
            same = (low ^ (low + wide)) < (np.uint64(1) << _TOP_SHIFT)
            need = same | (wide < _BOTTOM)
            lanes, low, wide, same = lanes[need], low[need], wide[need], same[need]
            wide = np.where(same, wide, (~low + np.uint64(1)) & (_BOTTOM - np.uint64(1)))
            self.shift(lanes, low)
            self.low[lanes], self.range[lanes] = low << _WORD, wide << _WORD

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        self.words[lanes, self.size[lanes]] = (low >> _TOP_SHIFT).astype(np.uint16)
        self.size[lanes] += 1

    def finish(self) -> None:
        lanes = np.arange(len(self.low))
        for _ in range(4):
            self.shift(lanes, self.low)
            self.low = self.low << _WORD


class Decoder(Encoder):
    def __init__(self, words: np.ndarray, starts: np.ndarray):
        n = len(starts)
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
        self.words, self.size = words, starts.astype(np.int64)
        self.code = np.zeros(n, np.uint64)
        for _ in range(4):
            self.shift(np.arange(n), self.low)

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = np.minimum(self.size[lanes], len(self.words) - 1)
        self.code[lanes] = (self.code[lanes] << _WORD) | self.words[at].astype(np.uint64)
        self.size[lanes] += 1

    def get(self, lanes: np.ndarray, log: int) -> np.ndarray:
        """Where the code lies under cumulative frequencies that sum to 2**log."""
        r = self.range[lanes] >> np.uint64(log)
        return np.minimum((self.code[lanes] - self.low[lanes]) // r, np.uint64((1 << log) - 1)).astype(np.int64)


def _event(lanes: Lanes, coder: Encoder, kind: int, who: np.ndarray, ids: np.ndarray | None) -> np.ndarray:
    """Code or decode whether the candidate of the event is right for the lanes ``who``."""
    p = lanes.mix(kind, who)
    right = (lanes.cand[1 - kind][who] == ids[who]).astype(np.int64) if ids is not None else (coder.get(who, EVENT_LOG) < p).astype(np.int64)
    coder.put(who, np.where(right, 0, p), np.where(right, p, (1 << EVENT_LOG) - p), EVENT_LOG)
    lanes.learn(kind, who, right)
    return right.astype(bool)


def _step(lanes: Lanes, coder: Encoder, m: int, ids: np.ndarray | None, symbols: np.ndarray | None) -> np.ndarray:
    """One id of each of the first m lanes; the ids, given or decoded."""
    lanes.contexts(m)
    out = np.zeros(m, np.int64)
    left = np.ones(m, bool)
    for kind in range(2):  # candidate of order 2, then of order 1 where it is another one
        other = left & (lanes.held[1 - kind] > 0)
        if kind:
            other &= (lanes.held[1] == 0) | (lanes.cand[0] != lanes.cand[1])
        who = np.flatnonzero(other)
        if len(who):
            right = who[_event(lanes, coder, kind, who, ids)]
            out[right], left[right] = lanes.cand[1 - kind][right], False
    who = np.flatnonzero(left)
    if len(who):
        zero = lanes.zero
        found = ids[who] if ids is not None else symbols[coder.get(who, ORDER0_LOG)]
        rank = zero.rank[found]
        coder.put(who, zero.cum[rank], zero.freq[rank], ORDER0_LOG)
        out[who] = found
    coder.settle(m)
    lanes.advance(m, out)
    return out


def _lengths(n: int) -> np.ndarray:
    """Ids of each block: BLOCK, but for a shorter last one."""
    return np.minimum(BLOCK, n - np.arange(0, n, BLOCK))


def encode(ids: np.ndarray) -> bytes:
    """One record: ids below 2**16 in independent blocks."""
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    ids = ids.astype(np.int64)
    if n and (ids.min() < 0 or ids.max() >= 1 << 16):
        raise ValueError("the format holds ids of 16 bits")
    zero = OrderZero(*np.unique(ids, return_counts=True))
    table = zlib.compress(np.diff(zero.ids, prepend=0).astype("<u4").tobytes() + zero.counts.astype("<u4").tobytes(), 6)
    steps = min(n, BLOCK)
    coder, lanes = Encoder(blocks, steps), Lanes(blocks, zero)
    padded = np.zeros(blocks * BLOCK, np.int64)
    padded[:n] = ids
    columns, lengths = padded.reshape(blocks, BLOCK).T.copy(), _lengths(n)
    for step in range(steps):
        m = int((lengths > step).sum())
        _step(lanes, coder, m, columns[step, :m], None)
    coder.finish()
    sums = [zlib.crc32(ids[a : a + BLOCK].astype("<u4").tobytes()) for a in range(0, n, BLOCK)]
    words = [coder.words[k, : coder.size[k]].astype("<u2").tobytes() for k in range(blocks)]
    head = struct.pack("<4sQIII", MAGIC, n, blocks, len(table), len(zero.ids))
    return head + table + np.array([coder.size, sums], "<u4").reshape(2, blocks).tobytes() + b"".join(words)


def decode_blocks(record: bytes, which: list[int] | None = None) -> dict[int, np.ndarray | None]:
    """The ids of some blocks of a record (default: all), by number; None for a block whose checksum is wrong.

    Blocks are read independently of each other. ValueError where the record's form or its table is damaged.
    """
    head = struct.calcsize("<4sQIII")
    if len(record) < head:
        raise ValueError("a record of ids is cut short")
    magic, n, blocks, table_size, kinds = struct.unpack_from("<4sQIII", record)
    if magic != MAGIC or blocks != -(-n // BLOCK):
        raise ValueError("not a record of ids")
    try:
        table = np.frombuffer(zlib.decompress(record[head : head + table_size]), "<u4").astype(np.int64)
    except zlib.error as damage:
        raise ValueError("the table of a record of ids is damaged") from damage
    if len(table) != 2 * kinds or len(record) < head + table_size + 8 * blocks:
        raise ValueError("a record of ids is cut short")
    at = head + table_size
    sizes, sums = np.frombuffer(record, "<u4", 2 * blocks, at).reshape(2, blocks).astype(np.int64)
    if len(record) != at + 8 * blocks + 2 * int(sizes.sum()):
        raise ValueError("a record of ids is cut short")
    chosen = np.array(sorted(range(blocks) if which is None else set(which)), np.int64)  # the shorter block comes last
    if not len(chosen):
        return {}
    words, zero = np.frombuffer(record, "<u2", -1, at + 8 * blocks), OrderZero(np.cumsum(table[:kinds]), table[kinds:])
    coder, lanes, symbols = Decoder(words, (np.cumsum(sizes) - sizes)[chosen]), Lanes(len(chosen), zero), zero.symbols()
    lengths = _lengths(n)[chosen]
    columns = np.zeros((int(lengths[0]), len(chosen)), np.int64)
    for step in range(len(columns)):
        m = int((lengths > step).sum())
        columns[step, :m] = _step(lanes, coder, m, None, symbols)
    out: dict[int, np.ndarray | None] = {}
    for place, k in enumerate(chosen.tolist()):
        ids = columns[: lengths[place], place]
        out[k] = ids if zlib.crc32(ids.astype("<u4").tobytes()) == sums[k] else None
    return out


def decode(record: bytes) -> np.ndarray:
    """The ids of a record; ValueError where a block's checksum, the table or the record's form is wrong."""
    blocks = decode_blocks(record)
    for k, ids in blocks.items():
        if ids is None:
            raise ValueError(f"block {k} of a record of ids is damaged")
    return np.concatenate(list(blocks.values())) if blocks else np.zeros(0, np.int64)
