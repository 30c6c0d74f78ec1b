"""Adaptive context-mixing range coder for token ids, run in lock step over many independent blocks.

A frame holds many blocks of up to BLOCK ids. Its header lists how frequent its ids are, which sorts them into CLASSES bands of about equal weight, the
frequent ids first. Every block starts from the same state, ends in its own flush, and carries the CRC-32 of its ids, so a block is decoded from the
header and its own words alone. Within a block three orders predict the next id. Order 2 and order 1 each name the id that followed the last two ids, or
the last one, with a confidence of 0 to 3. How likely each of them is right is learned twice, by the pair of confidences and by its own with which predictions
came true lately, and both chances are mixed. Where neither is right, order 0 tells the id: an adaptive distribution over the bands, then the place in the band by
the frame's frequencies.

Choices are intervals of a range coder with a window of 62 bits that puts out words of 32. Totals are powers of two, so encoding needs no division. A carry
is left in the word it belongs to, and all carries are passed on at the end. numpy does one position of all blocks at a time: the arithmetic is
that of a scalar coder per block.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
#: Places of a block for contexts of order 2 and of order 1.
SLOTS = (2048, 512)
CLASSES = 16
MAGIC = b"TIB2"
#: Bits of the chances of flags and of the bands' distribution, which make up one interval, and of places in a band.
BITS, PLACE = 12, 16
_U = np.uint64
_LEAST, _MASK30, _MASK32 = _U(1 << 30), _U((1 << 30) - 1), _U((1 << 32) - 1)
#: No id: what a context without history predicts.
_NONE = 0xFFFF
#: Chances of 2**16 move towards these, so that none gets near 0 or 1.
_LOW, _HIGH = 40, 65_500
#: Numbers of the bounds between bands. After band c was seen, bound j moves to j, or to j + 2**BITS - CLASSES if it is above c; every band keeps a width of 1 at least.
_INNER = np.arange(1, CLASSES, dtype=np.int16)[:, None]
#: Chances that a prediction of confidence 0 to 3 is right, before anything is learned.
_PRIOR = np.array([60, 15_000, 35_000, 55_000], np.int32)
#: Confidence, above an id, after one of 0 to 3 was wrong, then right.
_CONFIDENCE = np.array([1, 1, 1, 2, 1, 2, 3, 3], np.int32) << 16
#: The last two flags after another one, by 4 times the former plus the latter.
_PASTS = np.array([k % 12 // 4 * 12 + k % 4 * 4 for k in range(36)])
#: Which prediction is told, by 2 if order 2 is right plus 1 if order 1 is.
_FLAGS = np.array([2, 1, 0, 0])
_START = np.array([j * (1 << BITS) // CLASSES for j in range(CLASSES + 1)], np.int16)


def frequencies(counts: np.ndarray, total: int) -> np.ndarray:
    """Positive counts scaled to a sum of total, at least 1 each."""
    share = counts.astype(np.float64) * (total - len(counts)) / counts.sum()
    out = 1 + share.astype(np.int64)
    out[np.argsort(-(share - share.astype(np.int64)), kind="stable")[: total - int(out.sum())]] += 1
    out[int(out.argmax())] += total - int(out.sum())
    return out


class _Bands:
    """Ids in order of their frequency, cut into bands, with frequencies of a sum of 2**PLACE in each."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        order = np.argsort(-counts, kind="stable")
        ids, counts = ids[order].astype(np.int64), counts[order]
        before = np.cumsum(counts) - counts
        band = np.minimum(before * CLASSES // max(1, int(counts.sum())), CLASSES - 1)
        self.band, low, wide = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int64)
        self.band[ids] = band
        self.by_place = np.zeros((CLASSES, 1 << PLACE), np.uint16)
        for c in np.unique(band):
            mine = band == c
            width = frequencies(counts[mine], 1 << PLACE)
            wide[ids[mine]], low[ids[mine]] = width, np.cumsum(width) - width
            self.by_place[c] = np.repeat(ids[mine], width)
        self.interval = (low << PLACE | wide - 1).astype(np.uint32)  # one look for both

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' places in their bands begin, and how many they are."""
        interval = self.interval.take(ids).astype(np.uint64)
        width = interval & _U((1 << PLACE) - 1)
        width += _U(1)
        interval >>= _U(PLACE)
        return interval, width


class _State:
    """What blocks have learned. Arrays of two rows hold order 2 and order 1; both rows go through numpy at once, whose calls cost more than their work."""

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.slots_at = np.stack([lane * SLOTS[0], lanes * SLOTS[0] + lane * SLOTS[1]])
        self.conf_at = np.stack([lane * 16, (lanes + lane) * 16])
        self.past_at = np.stack([lane * 36, (lanes + lane) * 36])
        # predicted id and, above it, confidence
        self.table = np.full(lanes * sum(SLOTS), _NONE, np.int32)
        # chances of 2**16 that order 2 is right, and that order 1 is if order 2 isn't
        self.by_conf = np.concatenate([np.tile(np.repeat(_PRIOR, 4), lanes), np.tile(_PRIOR, 4 * lanes)])
        self.by_past = np.tile(_PRIOR, 2 * 9 * lanes)
        self.bounds = np.repeat(_START[:, None], lanes, 1)
        self.p1, self.p2 = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.past = np.full(lanes, 32)  # 4 times both last flags, in threes
        self.range = np.full(lanes, (1 << 62) - 1, np.uint64)
        self.lane = lane
        self.only(lanes)

    def only(self, n: int) -> None:
        """From now on the first n lanes take part."""
        self.p1, self.p2, self.past, self.lane = self.p1[:n], self.p2[:n], self.past[:n], self.lane[:n]
        self.slots_at, self.conf_at, self.past_at = (np.ascontiguousarray(x[:, :n]) for x in (self.slots_at, self.conf_at, self.past_at))
        self.gate = np.ones((2, n), np.int32)
        self.bands, self.change = np.zeros(n, np.int16), np.empty((CLASSES - 1, n), np.int16)
        self.inner = self.bounds[1:-1, :n]

    def look(self) -> None:
        """Predictions, and the widths of both flags of 2**BITS."""
        h = self.p1 * 40503
        slots = np.empty_like(self.slots_at)
        two = self.p2 * 30011
        two += h
        two >>= 3
        np.bitwise_and(two, SLOTS[0] - 1, out=slots[0])
        h >>= 4
        np.bitwise_and(h, SLOTS[1] - 1, out=slots[1])
        slots += self.slots_at
        self.slots = slots.reshape(-1)
        held = self.table.take(slots)
        self.ids, self.conf = held & 0xFFFF, held >> 16
        pair = self.conf[0] << 2
        pair += self.conf[1]
        a = self.conf_at + pair
        b = self.past_at + self.past
        b += self.conf
        self.at = a.reshape(-1), b.reshape(-1)
        self.chances = self.by_conf.take(a), self.by_past.take(b)
        p = self.chances[0] + self.chances[1]
        p >>= 17 - BITS
        self.two, rest = p[0], (1 << BITS) - p[0]
        one = rest * p[1]
        one >>= BITS
        self.one = np.maximum(one, 1, out=one)
        self.none = rest - one

    def learn(self, ids: np.ndarray, flag: np.ndarray, right: np.ndarray) -> None:
        """flag: 0 where order 2 was right, 1 where only order 1 was, else 2; right: which were, in two rows."""
        # a prediction of confidence 2 or 3 outlives an error
        fresh = ids.astype(np.int32)
        new = self.ids ^ fresh
        new &= -(self.conf >> 1)
        new ^= fresh
        new |= _CONFIDENCE.take(self.conf + (right.view(np.int8) << 2))
        self.table[self.slots] = new.reshape(-1)
        goal = right * np.int32(_HIGH - _LOW)
        goal += np.int32(_LOW)
        self.gate[1] = flag > 0
        for chances, before, at, pace in zip((self.by_conf, self.by_past), self.chances, self.at, (4, 5), strict=True):
            step = goal - before
            step >>= pace
            step *= self.gate
            step += before
            chances[at] = step.reshape(-1)
        self.p2[:] = self.p1
        self.p1[:] = ids
        self.past += flag
        self.past[:] = _PASTS.take(self.past)

    def moved(self, neither: np.ndarray, bands: np.ndarray, flag: np.ndarray) -> None:
        """Bounds of the given lanes move towards those of their bands; all lanes are worked out, the others by 0."""
        self.bands[neither] = bands
        change = np.subtract(self.bands, _INNER, out=self.change)
        change >>= 15  # -1 above the band
        change &= (1 << BITS) - CLASSES
        change += _INNER
        change -= self.inner
        change >>= 5
        change &= -(flag == 2).view(np.int8)
        self.inner += change


def encode(ids: np.ndarray) -> bytes:
    """A frame of the given ids (uint16, below 65535)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint16)
    counts = np.bincount(ids, minlength=1)
    listed = np.flatnonzero(counts)
    bands = _Bands(listed, counts[listed])
    lanes = -(-len(ids) // BLOCK)
    padded = np.zeros(lanes * BLOCK, np.uint16)
    padded[: len(ids)] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)  # a step reads one row
    del padded
    state = _State(lanes)
    low, rng = np.zeros(lanes, np.uint64), state.range
    words = np.zeros((lanes, BLOCK + 4), np.uint64)
    flat = words.reshape(-1)
    first = np.arange(lanes) * words.shape[1]
    at = first.copy()
    short = len(ids) - BLOCK * (lanes - 1)

    def shift(lane: np.ndarray) -> None:
        own, place = low[lane], at[lane]
        flat[place] = own >> _U(30)
        at[lane] = place + 1
        low[lane] = (own & _MASK30) << _U(32)
        rng[lane] <<= _U(32)

    n = lanes
    for t in range(min(BLOCK, len(ids))):
        if t == short:
            n = lanes - 1
            state.only(n)
        x = grid[t, :n].astype(np.int64)
        state.look()
        hits = x == state.ids
        flag = _FLAGS.take(hits[0] * np.int8(2) + hits[1])
        first2 = flag == 0
        lo = state.two * (flag > 0)
        lo <<= BITS
        width = np.where(first2, state.two, state.one)
        width <<= BITS
        neither = np.flatnonzero(flag == 2)
        own = x.take(neither)
        c = bands.band.take(own)
        at_bound = c * np.int64(lanes)
        at_bound += neither
        left = state.bounds.reshape(-1).take(at_bound).astype(np.int32)
        at_bound += lanes
        right = state.bounds.reshape(-1).take(at_bound) - left
        none = state.none.take(neither)
        left *= none
        left += state.one.take(neither) << BITS
        left += lo.take(neither)
        lo[neither] = left
        right *= none
        width[neither] = right
        state.moved(neither, c, flag)
        r = rng[:n] >> _U(2 * BITS)
        low[:n] += r * lo.astype(np.uint64)
        r *= width.astype(np.uint64)
        rng[:n] = r
        shift(np.flatnonzero(r < _LEAST))
        r = rng.take(neither)
        r >>= _U(PLACE)
        begin, wide = bands.of(own)
        begin *= r
        begin += low.take(neither)
        low[neither] = begin
        r *= wide
        rng[neither] = r
        shift(neither[r < _LEAST])
        state.learn(x, flag, hits)
    for _ in range(2):
        shift(np.arange(lanes))
    sizes = at - first
    words = words[:, : int(sizes.max(initial=0))]
    for k in range(int(sizes.max(initial=0)) - 1, 0, -1):  # words behind a block's end are 0
        words[:, k - 1] += words[:, k] >> _U(32)
    body = (words & _MASK32).astype("<u4")[np.arange(words.shape[1]) < sizes[:, None]] if lanes else np.empty(0, "<u4")
    wide = ids.astype("<u4")
    crc = np.array([zlib.crc32(wide[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(lanes)], "<u4")
    head = zlib.compress(np.diff(listed, prepend=0).astype("<u2").tobytes() + counts[listed].astype("<u4").tobytes(), 6)
    return b"".join((MAGIC, struct.pack("<QII", len(ids), len(listed), len(head)), head, sizes.astype("<u4").tobytes(), crc.tobytes(), body.tobytes()))


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; raises ValueError if anything in it does not match."""
    if frame[:4] != MAGIC:
        raise ValueError("not a frame")
    count, n_listed, n_head = struct.unpack_from("<QII", frame, 4)
    head = zlib.decompress(frame[20 : 20 + n_head])
    if len(head) != 6 * n_listed:
        raise ValueError("damaged list of ids")
    listed = np.cumsum(np.frombuffer(head, "<u2", n_listed).astype(np.int64))
    bands = _Bands(listed, np.frombuffer(head, "<u4", n_listed, 2 * n_listed).astype(np.int64))
    places = bands.by_place.reshape(-1)
    lanes, start = -(-count // BLOCK), 20 + n_head
    if len(frame) < start + 8 * lanes or (len(frame) - start) % 4:
        raise ValueError("frame is cut short")
    sizes = np.frombuffer(frame, "<u4", lanes, start).astype(np.int64)
    crc = np.frombuffer(frame, "<u4", lanes, start + 4 * lanes)
    body = np.frombuffer(frame, "<u4", -1, start + 8 * lanes)
    if len(body) != sizes.sum() or (sizes < 2).any():
        raise ValueError("frame is cut short")
    body = np.concatenate([body, np.zeros(2, np.uint32)]).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    # the window is two bits short of two words, so what comes in is a word that begins there
    code = body[at] << _U(30) | body[at + 1] >> _U(2)
    coming = (body[:-1] & _U(3)) << _U(30) | body[1:] >> _U(2)
    at += 1
    last = len(coming) - 1
    state = _State(lanes)
    rng = state.range
    grid = np.zeros((BLOCK, lanes), np.uint16)
    short = count - BLOCK * (lanes - 1)

    def shift(lane: np.ndarray) -> None:
        place = at[lane]
        code[lane] = code[lane] << _U(32) | coming[np.minimum(place, last)]
        at[lane] = place + 1
        rng[lane] <<= _U(32)

    n = lanes
    for t in range(min(BLOCK, count)):
        if t == short:
            n = lanes - 1
            state.only(n)
        state.look()
        r = rng[:n] >> _U(2 * BITS)
        v = np.minimum(code[:n] // r, _U((1 << 2 * BITS) - 1)).astype(np.int32)
        two = state.two << BITS
        one = state.one << BITS
        split = two + one
        is2, none_right = v < two, v >= split
        flag = np.where(is2, 0, 1 + none_right)
        lo = two * (flag > 0)
        width = np.where(is2, two, one)
        x = np.where(is2, state.ids[0], state.ids[1]).astype(np.int64)
        neither = np.flatnonzero(none_right)
        none, base = state.none.take(neither), split.take(neither)
        u = np.zeros(n, np.int16)
        u[neither] = np.minimum((v.take(neither) - base) / none, (1 << BITS) - 1)  # exact below 2**53
        c = np.add.reduce((state.inner <= u).view(np.int8), 0, dtype=np.int8).take(neither)
        at_bound = c * np.int64(lanes)
        at_bound += neither
        left = state.bounds.reshape(-1).take(at_bound).astype(np.int32)
        at_bound += lanes
        right = state.bounds.reshape(-1).take(at_bound) - left
        left *= none
        left += base
        lo[neither] = left
        right *= none
        width[neither] = right
        state.moved(neither, c, flag)
        code[:n] -= r * lo.astype(np.uint64)
        r *= width.astype(np.uint64)
        rng[:n] = r
        shift(np.flatnonzero(r < _LEAST))
        r = rng.take(neither)
        r >>= _U(PLACE)
        own = code.take(neither)
        place = np.minimum(own // r, _U((1 << PLACE) - 1)).astype(np.int64)
        place += c * np.int64(1 << PLACE)
        found = places.take(place)
        begin, wide = bands.of(found)
        begin *= r
        own -= begin
        code[neither] = own
        r *= wide
        rng[neither] = r
        shift(neither[r < _LEAST])
        x[neither] = found
        grid[t, :n] = x
        state.learn(x, flag, x == state.ids)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:count]
    wide = ids.astype("<u4")
    for i in range(lanes):
        if zlib.crc32(wide[i * BLOCK : (i + 1) * BLOCK].tobytes()) != crc[i]:
            raise ValueError(f"block {i} does not match its checksum")
    return ids
