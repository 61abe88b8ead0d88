"""An adaptive context-mixing range coder for token ids, many blocks at a time.

Three predictions are mixed for each id: the frequencies of all ids so far (order 0), and the
ids expected behind the previous id (order 1) and behind the previous two (order 2). An id's
share of the range is the weighted sum of what they give it. The weights, in 64ths, depend on how
often the two expected ids have held of late, and follow the record of such pairs; order 0 has
one 64th at least, and gives every id of the segment's alphabet a part. An expected id that fails
loses trust first and its place then.

All blocks of a segment take each step together, in NumPy arrays with an element for each block,
and share the models, which learn from all of them after the step; frequencies are renewed when
the steps have grown by half. Models begin anew in every segment and hold integers only, so a
decoder repeats the encoder's steps exactly. A block cannot be decoded without the others.

A segment's bytes are, little-endian: MAGIC, the number of blocks; of each block its ids, its
bytes and the CRC-32 of its ids as 32-bit integers; the size of the alphabet, and the CRC-32 of
all that; then the blocks' bytes. Empty segments have no blocks. Ids of over 16 bits are coded in
halves: WIDE, the bytes of the segment of the higher halves, and the segments of the higher and
the lower ones.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC, WIDE, BLOCK_IDS = b"QMT3", b"QMT4", 512
#: Bits of the weights, of the frequencies, and of both together: what the range is divided by.
_WEIGHT, _PART = 6, 20
_WHOLE = _WEIGHT + _PART
#: Slots for what follows two ids, and bits of the trust in an expected id.
_SLOTS, _TRUST = 1 << 18, 3
_MOST = (1 << _TRUST) - 1
#: Steps from one renewal of the weights to the next, and what an id adds to its frequency.
_EVERY, _RAISE = 8, 8
#: Bits of the range kept free, and of a digit that is put out.
_FLOOR, _DIGIT = 30, 32


class SegmentError(ValueError):
    """The bytes are no segment, or a checksum does not hold."""


class _Encoder:
    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, 1 << _FLOOR + _DIGIT, np.int64)
        self.out, self.at = np.zeros((16, lanes), np.int64), np.zeros(lanes, np.int64)

    def code(self, mix: _Mixer, ids: np.ndarray) -> np.ndarray:
        n = len(ids)
        begin, width = mix.interval(ids)
        unit = self.range[:n] >> _WHOLE
        self.low[:n] += unit * begin
        unit *= width
        self.range[:n] = unit
        self._shift(np.flatnonzero(unit < 1 << _FLOOR))
        return ids

    def _shift(self, full: np.ndarray) -> None:
        at = self.at.take(full)
        if at.max(initial=0) >= len(self.out):
            self.out = np.concatenate([self.out, np.zeros_like(self.out)])
        low = self.low.take(full)
        # A digit may exceed its 32 bits by a carry, which is settled at the end.
        self.out[at, full] = low >> _FLOOR
        self.at[full] = at + 1
        self.low[full] = (low & (1 << _FLOOR) - 1) << _DIGIT
        self.range[full] <<= _DIGIT

    def finish(self) -> tuple[np.ndarray, bytes]:
        """Each block's number of bytes, and the bytes of all."""
        for _ in range(2):
            self._shift(np.arange(len(self.low)))
        for k in range(len(self.out) - 1, 0, -1):
            self.out[k - 1] += self.out[k] >> _DIGIT
        digits = self.out.T.astype("<u4")
        return self.at * 4, digits[np.arange(len(self.out)) < self.at[:, None]].tobytes()


class _Decoder:
    def __init__(self, sizes: np.ndarray, payloads: bytes):
        digits = np.frombuffer(payloads, "<u4").astype(np.int64)
        first = np.cumsum(sizes >> 2) - (sizes >> 2)
        # The value holds 62 bits, so it ends amid a digit; `next` has the 32 bits that follow such an end.
        self.value = digits[first] << _FLOOR | digits[first + 1] >> _DIGIT - _FLOOR
        self.next = digits >> _DIGIT - _FLOOR
        self.next[1:] |= (digits[:-1] & (1 << _DIGIT - _FLOOR) - 1) << _FLOOR
        self.at, self.range = first + 2, np.full(len(sizes), 1 << _FLOOR + _DIGIT, np.int64)

    def code(self, mix: _Mixer, n: int) -> np.ndarray:
        value, unit = self.value[:n], self.range[:n] >> _WHOLE
        place = (value.view(np.uint64) // unit.view(np.uint64)).view(np.int64)
        ids = mix.find(np.minimum(place, (1 << _WHOLE) - 1).astype(np.int32))
        begin, width = mix.interval(ids)
        value -= unit * begin
        unit *= width
        self.range[:n] = unit
        full = np.flatnonzero(unit < 1 << _FLOOR)
        at = self.at.take(full)
        value[full] = value.take(full) << _DIGIT | self.next.take(at, mode="clip")
        self.at[full] = at + 1
        self.range[full] <<= _DIGIT
        return ids


class _Mixer:
    """The adaptive models that all blocks share, and the mixture for the step at hand."""

    def __init__(self, symbols: int):
        self.seen = np.ones(symbols, np.int64)
        # The expected id and, in the lowest bits, the trust in it, by the last id and by the last two.
        self.after = np.zeros(1 << 16, np.int32), np.zeros(_SLOTS, np.int32)
        # By the trust in both: how often such a pair stood there, and how often the first and the second held.
        self.stood, self.held = np.full(1 << 2 * _TRUST, 4, np.int64), np.ones((2, 1 << 2 * _TRUST), np.int64)
        self.weigh()
        self.count(np.zeros(0, np.int32))

    def count(self, ids: np.ndarray) -> None:
        """Renew the frequencies by these ids."""
        self.seen += np.bincount(ids, minlength=len(self.seen)) * _RAISE
        part = 1 + self.seen * ((1 << _PART) - len(self.seen)) // self.seen.sum()
        part[part.argmax()] += (1 << _PART) - part.sum()
        self.part, self.below = part.astype(np.int32), (np.cumsum(part) - part).astype(np.int32)
        self.symbol = np.repeat(np.arange(len(part), dtype=np.uint16), part)

    def weigh(self) -> None:
        """Renew the weights by the record. What both expect counts for the second."""
        most = (1 << _WEIGHT) - 1
        first, second = (self.held << _WEIGHT) // self.stood
        second = np.minimum(second, most)
        first = np.minimum(first, most - second)
        rest = most + 1 - first - second
        self.weights = [w.astype(np.int32) for w in (first << _PART, second << _PART, rest)]
        self.inverse = -(-(1 << 32) // rest)  # a place, below 2^26, times this has the quotient above bit 32

    def expect(self, last: np.ndarray, before: np.ndarray) -> None:
        self.slots = last, (last * 0x9E3779B1 ^ before * 0x85EBCA77) >> 15 & _SLOTS - 1
        self.found = [a.take(s) for a, s in zip(self.after, self.slots)]
        self.guess = [f >> _TRUST for f in self.found]
        self.trust = [f & _MOST for f in self.found]
        self.pair = self.trust[0] << _TRUST | self.trust[1]
        self.first, self.second, self.rest = (w.take(self.pair) for w in self.weights)

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the shares of these ids begin, and how wide they are."""
        self.right = [g == ids for g in self.guess]
        begin, width = self.rest * self.below.take(ids), self.rest * self.part.take(ids)
        for weight, guess, right in zip((self.first, self.second), self.guess, self.right):
            begin += weight * (guess < ids)
            width += weight * right
        return begin, width

    def find(self, place: np.ndarray) -> np.ndarray:
        """The ids in whose shares these places lie."""
        (one, two), (first, second) = self.guess, (self.first, self.second)
        # Take out what the two expected ids have beyond order 0; a place within it falls on the id's first place there.
        over_one = place - self.rest * self.below.take(one) - second * (two < one)
        over_two = place - self.rest * self.below.take(two) - first * (one <= two)
        plain = place - np.minimum(np.maximum(over_one, 0), first) - np.minimum(np.maximum(over_two, 0), second)
        return self.symbol.take(plain * self.inverse.take(self.pair) >> 32).astype(np.int32)

    def learn(self, ids: np.ndarray, record: bool) -> None:
        fresh = ids << _TRUST | 1
        for after, slots, found, trust, right in zip(self.after, self.slots, self.found, self.trust, self.right):
            # Where blocks share a slot, the last one's value stays.
            after[slots] = np.where(right | (trust > 1), found + right * (np.int8(1) + (trust < _MOST)) - 1, fresh)
        if record:
            one, two = self.right
            for counts, pairs in ((self.stood, self.pair), (self.held[0], self.pair[one & ~two]), (self.held[1], self.pair[two])):
                counts += np.bincount(pairs, minlength=len(counts))
            self.weigh()


def _run(coder, sizes: np.ndarray, symbols: int, ids: np.ndarray | None = None) -> np.ndarray:
    """All steps of all blocks, a row for each step; sizes fall from block to block."""
    mix, steps = _Mixer(symbols), int(sizes[0])
    out = np.zeros((steps, len(sizes)), np.int32) if ids is None else ids
    last, before = np.zeros((2, len(sizes)), np.int64)
    counted, due = 0, 1
    for t, n in enumerate(np.searchsorted(-sizes, -np.arange(1, steps + 1), "right").tolist()):
        if t == due:
            mix.count(out[counted:t].ravel())
            counted, due = t, t + 1 + t // 2
        mix.expect(last[:n], before[:n])
        found = coder.code(mix, n if ids is None else ids[t, :n])
        mix.learn(found, t < _EVERY or t % _EVERY == 0)
        out[t, :n] = found
        last, before = found.astype(np.int64), last
    return out


def encode_segment(ids: np.ndarray) -> bytes:
    """The bytes of a segment of unsigned 32-bit ids."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        high, low = encode_segment(ids >> 16), encode_segment(ids & 0xFFFF)
        return WIDE + struct.pack("<I", len(high)) + high + low
    if not len(ids):
        return MAGIC + struct.pack("<I", 0)
    block = min(BLOCK_IDS, max(64, math.isqrt(len(ids))))  # few ids: fewer steps, as each has its cost
    blocks = -(-len(ids) // block)
    sizes = np.minimum(block, len(ids) - block * np.arange(blocks))
    table, symbols = np.zeros(blocks * block, np.int32), int(ids.max()) + 1
    table[: len(ids)] = ids
    coder = _Encoder(blocks)
    _run(coder, sizes, symbols, np.ascontiguousarray(table.reshape(blocks, block).T[: sizes[0]]))
    lengths, payloads = coder.finish()
    raw = memoryview(ids.astype("<u4").tobytes())
    heads = [struct.pack("<III", n, k, zlib.crc32(raw[4 * block * i : 4 * (block * i + n)])) for i, (n, k) in enumerate(zip(sizes.tolist(), lengths.tolist()))]
    front = b"".join([MAGIC, struct.pack("<I", blocks), *heads, struct.pack("<I", symbols)])
    return front + struct.pack("<I", zlib.crc32(front)) + payloads


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment, after all its checksums have been compared."""
    if data[:4] == WIDE and len(data) >= 8:
        (high,) = struct.unpack_from("<I", data, 4)
        return decode_segment(data[8 : 8 + high]) << 16 | decode_segment(data[8 + high :])
    if data[:4] != MAGIC or len(data) < 8:
        raise SegmentError("no segment of token ids")
    (blocks,) = struct.unpack_from("<I", data, 4)
    if not blocks and len(data) == 8:
        return np.zeros(0, np.uint32)
    at = 12 + 12 * blocks
    if not blocks or len(data) < at + 4 or zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise SegmentError("the checksum of the head does not hold")
    sizes, lengths, crcs = np.frombuffer(data[8 : at - 4], "<u4").reshape(blocks, 3).T.astype(np.int64)
    if len(data) != at + 4 + lengths.sum():
        raise SegmentError("the blocks' bytes are not all there")
    table = _run(_Decoder(lengths, data[at + 4 :]), sizes, struct.unpack_from("<I", data, at - 4)[0])
    ids = np.ascontiguousarray(table.T)[np.arange(len(table)) < sizes[:, None]].astype("<u4")
    raw, begin = memoryview(ids.tobytes()), 0
    for i, (n, crc) in enumerate(zip(sizes.tolist(), crcs.tolist())):
        if zlib.crc32(raw[4 * begin : 4 * (begin + n)]) != crc:
            raise SegmentError(f"the checksum of block {i} does not hold")
        begin += n
    return ids.astype(np.uint32)
