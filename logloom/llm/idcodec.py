"""Adaptive context-mixing range coder for token ids of up to 16 bits.

A block holds up to ``BLOCK`` ids and is coded on its own: its models start afresh, and a checksum covers
its ids. Blocks are lanes of one numpy computation: step t codes the t-th id of all of them.

Model of a lane. Orders 1 and 2 each predict one id from the last one (two) ids, by a hashed table of the id
last confirmed there and a confidence of 0 to 3. Order 0 is a distribution of ids: of the high byte, and of the
low byte given the class of the high one, from counts that are taken over at the steps in ``REBUILD``. The three are
mixed: in the context of both confidences and of whether both predictions agree, adaptive weights give
the shares of the order-2 prediction, the order-1 prediction and order 0.

An id is coded by its source (order 2, order 1 or order 0, in units of 2**-12 of these shares) and, if that is order 0, by its
share of order 0, in units of 2**-20; order 0 counts the ids that it codes. A block has a range coder for either, whose steps are
thus independent: those of order 0 need no prediction, and the sources need no distribution. Their states have 60 bits;
they write 16-bit words and carry into words already written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
LANES = 1024
MAGIC = b"CMIX0002"
SOURCE_BITS, BYTE_BITS = 12, 10
STATE_BITS, LOW_BITS = 60, 44
STATE_MASK, WORD_MASK = (1 << STATE_BITS) - 1, (1 << LOW_BITS) - 1
#: Words that hold a state.
STATE_WORDS = 4
#: Steps between two looks at the width of sources and of order 0, which keep it above 2**8 and 2**4 units.
SOURCE_EVERY, ID_EVERY = 3, 2
ORDER1_BITS, ORDER2_BITS = 9, 10
REBUILD = (0, 64, 192, 448, 960, 1984, 3008)
#: Class of a high byte, for the low byte's context: single bytes, early merges, the others.
HIGH_CLASS = np.repeat(np.arange(4), [2, 2, 12, 240])
N_CLASSES = 4
#: Weights learn by 1/8 of the error at every second step; they are kept in 16 bits and start at a guess from the confidences.
RATE, WEIGH_EVERY = 3, 2


def _i32(*values) -> np.ndarray:
    """A constant; numpy takes arrays faster than Python's numbers."""
    return np.array(values, np.int32)


_TWO, _THREE, _RATE, _SLOTS = _i32(2), _i32(3), _i32(RATE), _i32(16)
_ONE, _MOST2, _MOST1 = _i32(1), _i32((1 << SOURCE_BITS) - 4), _i32((1 << SOURCE_BITS) - 2)
_CONTEXT = _i32([2], [8])
#: By confidence and hit, what is added to an entry: KEPT makes it larger than any other that could take its place, -KEPT smaller.
KEPT = 1 << 30
_STEP = _i32(-KEPT, 1, -KEPT, 1, KEPT - 1, 1, KEPT - 1, 0)
_ENTRY, _WHOLE = _i32(KEPT - 1), _i32(65535)
_HASH1, _HASH2 = np.array([40503]), np.array([30011])
_HASH_SHIFT, _HASH_MASK = np.array([[5], [4]]), np.array([[(1 << ORDER1_BITS) - 1], [(1 << ORDER2_BITS) - 1]])


class Model:
    """Predictions of orders 1 and 2 and their weights for ``lanes`` blocks, as encoder and decoder keep them. Arrays of two rows
    have order 1 first. ``source`` is 0 for order 2, 1 for order 1, 2 for order 0."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.rows = np.stack([lane << ORDER1_BITS, (lanes << ORDER1_BITS) + (lane << ORDER2_BITS)])
        self.table = np.zeros((lanes << ORDER1_BITS) + (lanes << ORDER2_BITS), np.int32)
        conf2, conf1 = np.divmod(np.arange(32) >> 1, 4)
        self.weights = np.concatenate([np.tile(_i32(0, 12000, 30000, 48000)[conf1], lanes), np.tile(_i32(0, 16000, 40000, 56000)[conf2], lanes)])
        self.weight_rows = np.stack([lane << 5, (lanes + lane) << 5])
        pair, one = (2, lanes), lanes
        self.held, self.pred, self.conf, self.scaled, self.weight, self.step, self.drift = (np.empty(pair, np.int32) for _ in range(7))
        self.at_weight, self.key = np.empty(pair, np.int64), np.empty(pair, np.int64)
        self.hit, self.agree = np.empty(pair, bool), np.empty(one, bool)
        self.context, self.share2, self.share1, self.fresh = (np.empty(one, np.int32) for _ in range(4))
        self.hashed, self.hashed_before = np.empty(one, np.int64), np.zeros(one, np.int64)
        self.at = self.rows.copy()

    def predict(self) -> None:
        """Looks up both predictions; sets the two shares."""
        held, pred, conf, weight, share2, share1 = self.held, self.pred, self.conf, self.weight, self.share2, self.share1
        self.table.take(self.at, None, held, "clip")
        np.right_shift(held, _TWO, pred)
        np.bitwise_and(held, _THREE, conf)
        np.multiply(conf, _CONTEXT, self.scaled)
        np.add(self.scaled[0], self.scaled[1], self.context)
        np.equal(pred[0], pred[1], self.agree)
        np.add(self.context, self.agree, self.context)
        np.add(self.weight_rows, self.context, self.at_weight)
        self.weights.take(self.at_weight, None, weight, "clip")
        np.multiply(weight[1], _MOST2, share2)
        np.right_shift(share2, _SLOTS, share2)
        np.add(share2, _ONE, share2)
        np.subtract(_MOST1, share2, share1)
        np.multiply(share1, weight[0], share1)
        np.right_shift(share1, _SLOTS, share1)
        np.add(share1, _ONE, share1)

    def learn(self, ids: np.ndarray, not2: np.ndarray, weigh: bool) -> None:
        """Takes over ids (int32) whose ``hit`` is set, in the weights if ``weigh``; that of order 1 learns where order 2 was wrong."""
        key, step, drift = self.key, self.step, self.drift
        np.add(self.conf, self.conf, key)
        np.add(key, self.hit, key)
        _STEP.take(key, None, step, "clip")
        np.add(step, self.held, step)
        np.left_shift(ids, _TWO, self.fresh)
        np.add(self.fresh, _ONE, self.fresh)
        np.maximum(step, self.fresh, step)  # an entry that was hit is no smaller
        np.bitwise_and(step, _ENTRY, step)
        self.table[self.at] = step
        if weigh:
            np.multiply(self.hit, _WHOLE, drift)
            np.subtract(drift, self.weight, drift)
            np.right_shift(drift, _RATE, drift)
            np.multiply(drift[0], not2, drift[0])
            np.add(drift, self.weight, drift)
            self.weights[self.at_weight] = drift
        at, hashed = self.at, self.hashed
        np.multiply(ids, _HASH1, hashed)
        at[0] = hashed
        np.add(hashed, self.hashed_before, at[1])
        np.multiply(ids, _HASH2, self.hashed_before)
        np.right_shift(at, _HASH_SHIFT, at)
        np.bitwise_and(at, _HASH_MASK, at)
        np.add(at, self.rows, at)


class OrderZero:
    """Distributions of ids for ``lanes`` blocks."""

    def __init__(self, lanes: int):
        self.lanes = lanes
        self.high_counts = np.zeros((lanes, 256), np.int32)
        self.low_counts = np.zeros((lanes * N_CLASSES, 256), np.int32)

    def count(self, ids: np.ndarray, held: np.ndarray) -> None:
        """Takes over the ids of some steps, [step, lane], where ``held``."""
        lane = np.broadcast_to(np.arange(self.lanes), ids.shape)[held]
        high, low = ids[held] >> 8, ids[held] & 255
        self.high_counts += np.bincount(lane * 256 + high, minlength=self.lanes * 256).reshape(self.high_counts.shape)
        key = (lane * N_CLASSES + HIGH_CLASS[high]) * 256 + low
        self.low_counts += np.bincount(key, minlength=self.low_counts.size).reshape(self.low_counts.shape)

    def rebuild(self, lookup: bool) -> None:
        """Shares from the counts; every byte keeps 1/1024 at least."""
        for name, counts in (("high", self.high_counts), ("low", self.low_counts)):
            room = (1 << BYTE_BITS) - 256
            total = np.maximum(counts.sum(1, keepdims=True), 1)
            share = (counts * (room / total)).astype(np.int32)
            share += 1
            share[np.arange(len(share)), counts.argmax(1)] += (1 << BYTE_BITS) - share.sum(1, dtype=np.int32)
            starts = np.cumsum(share, 1, dtype=np.int32)
            starts -= share
            setattr(self, f"{name}_share", share.ravel())
            setattr(self, f"{name}_start", starts.ravel())
            if lookup:
                setattr(self, f"{name}_of", np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(share)), share.ravel()))


def _segments(steps: int) -> list[tuple[int, int]]:
    cuts = [r for r in REBUILD if r < steps] + [steps]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _range_encode(start: np.ndarray, share: np.ndarray, counts: np.ndarray, bits: int, every: int) -> tuple[np.ndarray, np.ndarray]:
    """Intervals [step, lane] in units of 2**-bits → words [lane, word] uint16 and the number of words of each lane. Lanes have
    ``counts`` steps, in descending order."""
    steps, lanes = start.shape
    cap = (steps * (bits + 1)) // 16 + 2 * STATE_WORDS
    out = np.zeros(lanes * cap, np.uint16)
    pos = np.arange(lanes, dtype=np.int64) * cap
    low, width = np.zeros(lanes, np.int64), np.full(lanes, 1 << STATE_BITS, np.int64)
    unit, moved = np.empty(lanes, np.int64), np.empty(lanes, np.int64)
    shift, least, top = np.array([bits]), np.array([1 << LOW_BITS]), np.array([1 << STATE_BITS])
    active = lanes - np.searchsorted(counts[::-1], np.arange(steps), side="right")

    def emit(which: np.ndarray) -> None:
        part = low[which]
        at = pos[which]
        out[at] = part >> LOW_BITS
        pos[which] = at + 1
        low[which] = (part & WORD_MASK) << 16

    def settle() -> None:
        over = np.flatnonzero(low >= top)
        if len(over):
            low[over] &= STATE_MASK
            at = pos[over] - 1
            while len(at):
                out[at] += 1
                at = at[out[at] == 0] - 1
        small = np.flatnonzero(width < least)
        while len(small):
            emit(small)
            wider = width[small] << 16
            width[small] = wider
            small = small[wider < least]

    for k, n in enumerate(active.tolist()):
        u, m, w, lo = (unit, moved, width, low) if n == lanes else (unit[:n], moved[:n], width[:n], low[:n])
        np.right_shift(w, shift, u)
        np.multiply(u, start[k, :n], m)
        np.add(lo, m, lo)
        np.multiply(u, share[k, :n], w)
        if k % every == every - 1:
            settle()
    settle()
    lane = np.arange(lanes)
    for _ in range(STATE_WORDS):
        emit(lane)
    return out.reshape(lanes, cap), pos - lane * cap


class _RangeDecoder:
    """States of many range decoders, which begin at the places ``starts`` in ``words``."""

    def __init__(self, words: np.ndarray, shifted: np.ndarray, starts: np.ndarray):
        code = np.zeros(len(starts), np.int64)
        for k in range(STATE_WORDS - 1):
            code = (code << 16) | words.take(starts + k, mode="clip")
        self.code = (code << 12) | (words.take(starts + STATE_WORDS - 1, mode="clip") >> 4)
        self.at = starts + STATE_WORDS - 1
        self.width = np.full(len(starts), 1 << STATE_BITS, np.int64)
        self.shifted = shifted
        self.least = np.array([1 << LOW_BITS])

    def settle(self) -> None:
        code, width = self.code, self.width
        small = np.flatnonzero(width < self.least)
        while len(small):
            place = self.at[small]
            code[small] = (code[small] << 16) | self.shifted.take(place, mode="clip")
            self.at[small] = place + 1
            wider = np.maximum(width[small], 1) << 16  # 0 only in damaged blocks, which must end too
            width[small] = wider
            small = small[wider < self.least]


def _encode_lanes(ids: np.ndarray) -> list[np.ndarray]:
    """ids [step, lane] int32 → words of each lane: the number of ids by order 0 and of words of sources, words of sources, words of these ids."""
    steps, lanes = ids.shape
    model = Model(lanes)
    sources, shares = np.empty((steps, lanes), np.int8), np.empty((steps, 2, lanes), np.int16)
    hit, any_hit, not2 = model.hit, np.empty(lanes, bool), np.empty(lanes, bool)
    two = np.array([2], np.int8)
    for k in range(steps):
        x = ids[k]
        model.predict()
        shares[k, 0] = model.share2
        shares[k, 1] = model.share1
        np.equal(model.pred, x, hit)
        np.logical_or(hit[0], hit[1], any_hit)
        np.logical_not(hit[1], not2)
        np.subtract(two, any_hit, sources[k])
        np.subtract(sources[k], hit[1], sources[k])
        model.learn(x, not2, k % WEIGH_EVERY == 0)
    one, missed = sources == 1, sources == 2
    share, start = shares[:, 0].copy(), np.zeros((steps, lanes), np.int16)
    np.copyto(start, share, where=one | missed)
    start += shares[:, 1] * missed
    np.copyto(share, shares[:, 1], where=one)
    np.copyto(share, (1 << SOURCE_BITS) - start, where=missed)
    del shares, sources, one
    first, n_first = _range_encode(start, share, np.full(lanes, steps), SOURCE_BITS, SOURCE_EVERY)
    counts = missed.sum(0)
    second, n_second = _encode_ids(np.ascontiguousarray(ids.T)[np.ascontiguousarray(missed.T)], counts)
    return [np.concatenate([np.array([c, n], np.uint16), a[:n], b[:m]]) for c, n, m, a, b in zip(counts, n_first, n_second, first, second, strict=True)]


def _dealt(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes by descending count, and which steps [step, lane] they have."""
    order = np.argsort(-counts, kind="stable")
    return order, np.arange(counts.max(initial=0))[:, None] < counts[order]


def _encode_ids(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of order 0, lane by lane → words and their number."""
    order, held = _dealt(counts)
    steps, lanes = held.shape
    ids = np.zeros((lanes, steps), np.int32)
    by_lane = np.zeros((lanes, steps), np.int32)
    by_lane[np.arange(steps) < counts[:, None]] = flat
    ids = np.ascontiguousarray(by_lane[order].T)
    start, share = np.zeros((steps, lanes), np.int32), np.ones((steps, lanes), np.int32)
    zero, last = OrderZero(lanes), 0
    for begin, end in _segments(steps) if steps else []:
        if begin:
            zero.count(ids[last:begin], held[last:begin])
        zero.rebuild(False)
        last = begin
        high, low = ids[begin:end] >> 8, ids[begin:end] & 255
        key = np.arange(lanes) * 256 + high
        of_high = zero.high_share.take(key)
        start[begin:end] = zero.high_start.take(key) << BYTE_BITS
        key = (np.arange(lanes) * N_CLASSES + HIGH_CLASS[high]) * 256 + low
        start[begin:end] += of_high * zero.low_start.take(key)
        share[begin:end] = of_high * zero.low_share.take(key)
    words, n = _range_encode(start, share, counts[order], 2 * BYTE_BITS, ID_EVERY)
    back = np.argsort(order)
    return words[back], n[back]


def _decode_ids(words: np.ndarray, shifted: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids of order 0, lane by lane."""
    order, held = _dealt(counts)
    steps, lanes = held.shape
    coder = _RangeDecoder(words, shifted, starts[order])
    ids = np.zeros((steps, lanes), np.int32)
    active = held.sum(1).tolist()
    lane256, lane_class, lane_high = np.arange(lanes) * 256, np.arange(lanes) * N_CLASSES, np.arange(lanes) << BYTE_BITS
    shift, byte_bits, eight = np.array([2 * BYTE_BITS]), np.array([BYTE_BITS]), np.array([8])
    zero, last = OrderZero(lanes), 0
    for begin, end in _segments(steps) if steps else []:
        if begin:
            zero.count(ids[last:begin], held[last:begin])
        zero.rebuild(True)
        last = begin
        for k in range(begin, end):
            n = active[k]
            code, width = coder.code[:n], coder.width[:n]
            unit = np.right_shift(width, shift)
            value = code // unit
            high = zero.high_of.take(lane_high[:n] + (value >> byte_bits), mode="clip").astype(np.int64)
            key = lane256[:n] + high
            of_high = zero.high_share.take(key)
            begins = zero.high_start.take(key) << byte_bits
            row = lane_class[:n] + HIGH_CLASS.take(high)
            low = zero.low_of.take((row << byte_bits) + (value - begins) // of_high, mode="clip")
            key = (row << eight) + low
            begins += of_high * zero.low_start.take(key)
            code -= unit * begins
            np.multiply(unit, of_high * zero.low_share.take(key), width)
            np.add(high << eight, low, out=ids[k, :n], casting="unsafe")
            if k % ID_EVERY == ID_EVERY - 1:
                coder.settle()
    return np.ascontiguousarray(ids[:, np.argsort(order)].T)[np.arange(steps) < counts[:, None]]


def _decode_lanes(words: np.ndarray, starts: np.ndarray, steps: int) -> np.ndarray:
    """words, the place of each lane's first → ids [step, lane]. ``words`` has 8 spare ones at its end."""
    lanes = len(starts)
    shifted = ((words & 15) << 12) | np.append(words[1:], 0) >> 4
    counts, n_first = words[starts], words[starts + 1]
    if (counts > steps).any():
        raise ValueError("a block's head is damaged")
    by_zero = _decode_ids(words, shifted, starts + 2 + n_first, counts)
    by_zero = np.append(by_zero, np.int32(0))
    coder, model = _RangeDecoder(words, shifted, starts + 2), Model(lanes)
    code, width = coder.code, coder.width
    lane, wide = np.arange(lanes), np.array([lanes])
    ids = np.zeros((steps, lanes), np.int32)
    upcoming = np.cumsum(counts) - counts
    bounds = np.zeros((4, lanes), np.int64)  # of the three sources' intervals
    choices = np.empty((3, lanes), np.int32)
    unit, begins, source, place = (np.empty(lanes, np.int64) for _ in range(4))
    not2, missed = np.empty(lanes, bool), np.empty(lanes, bool)
    shift = np.array([SOURCE_BITS])
    all_bounds, ends, all_choices = bounds.ravel(), bounds[1:].ravel(), choices.ravel()
    for k in range(steps):
        x = ids[k]
        model.predict()
        np.right_shift(width, shift, unit)
        np.multiply(unit, model.share2, bounds[1])
        np.multiply(unit, model.share1, bounds[2])
        np.add(bounds[2], bounds[1], bounds[2])
        np.left_shift(unit, shift, bounds[3])
        np.greater_equal(code, bounds[1], not2)
        np.greater_equal(code, bounds[2], missed)
        np.add(not2, missed, out=source, dtype=np.int64)
        np.multiply(source, wide, place)
        np.add(place, lane, place)
        all_bounds.take(place, None, begins, "clip")
        ends.take(place, None, width, "clip")
        np.subtract(width, begins, width)
        np.subtract(code, begins, code)
        if k % SOURCE_EVERY == SOURCE_EVERY - 1:
            coder.settle()
        choices[0] = model.pred[1]
        choices[1] = model.pred[0]
        by_zero.take(upcoming, None, choices[2], "clip")
        np.add(upcoming, missed, upcoming)
        all_choices.take(place, None, x, "clip")
        np.equal(model.pred, x, model.hit)
        model.learn(x, not2, k % WEIGH_EVERY == 0)
    return ids


def encode_blocks(ids: np.ndarray) -> bytes:
    """Up to LANES * BLOCK ids as one superblock: number of ids, then per block its word count and the CRC32 of
    its ids as little-endian 32-bit integers, then the words."""
    n = len(ids)
    if n == 0:
        return struct.pack("<II", 0, 0)
    if int(ids.max()) > 0xFFFF or int(ids.min()) < 0:
        raise ValueError("ids of over 16 bits")
    steps = min(BLOCK, n)
    lanes = -(-n // steps)
    padded = np.zeros(lanes * steps, np.int32)
    padded[:n] = ids
    by_lane = padded.reshape(lanes, steps)
    words = _encode_lanes(np.ascontiguousarray(by_lane.T))
    counts = np.array([len(x) for x in words], "<u4")
    as32 = ids.astype("<u4")
    sums = np.array([zlib.crc32(as32[k * steps : (k + 1) * steps]) for k in range(lanes)], "<u4")
    return struct.pack("<II", n, lanes) + counts.tobytes() + sums.tobytes() + np.concatenate(words).astype("<u2").tobytes()


def superblock_size(head: bytes) -> tuple[int, int]:
    """Ids and lanes from a superblock's first 8 bytes."""
    return struct.unpack("<II", head)


def decode_blocks(body: bytes) -> np.ndarray:
    """The ids of one superblock; raises ValueError if a block's checksum doesn't hold."""
    n, lanes = superblock_size(body[:8])
    if n == 0:
        return np.zeros(0, np.int32)
    steps = min(BLOCK, n)
    counts = np.frombuffer(body, "<u4", lanes, 8).astype(np.int64)
    sums = np.frombuffer(body, "<u4", lanes, 8 + 4 * lanes)
    words = np.frombuffer(body, "<u2", int(counts.sum()), 8 + 8 * lanes)
    words = np.concatenate([words, np.zeros(8, np.uint16)]).astype(np.int64)
    with np.errstate(all="ignore"):  # damaged blocks may have values of any size, which their checksum tells
        ids = np.ascontiguousarray(_decode_lanes(words, np.cumsum(counts) - counts, steps).T).ravel()[:n]
    as32 = ids.astype("<u4")
    for k in range(lanes):
        if zlib.crc32(as32[k * steps : (k + 1) * steps]) != sums[k]:
            raise ValueError(f"block {k} is damaged")
    return ids


def superblock_bytes(head: bytes, counts: bytes) -> int:
    """Length of a superblock from its first 8 bytes and its word counts."""
    _, lanes = superblock_size(head)
    return 8 + 8 * lanes + 2 * int(np.frombuffer(counts, "<u4").sum())
