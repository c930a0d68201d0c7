"""Range coding of token ids with mixed order-0 to order-2 predictions, many blocks in step.

Blocks are reset and decoded independently of each other.  Since numpy works on whole arrays,
the blocks of a group advance together, one id of each per step; a block's bytes follow from its
ids and the :class:`Odds` alone, whatever other blocks are coded with it.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

#: Ids in a block.
BLOCK = 4096
#: Slots of the order-1 and order-2 contexts of a block.
SLOTS_1, SLOTS_2 = 512, 2048
#: Confidence of a prediction: hits in a row, up to this.
SURE = 7
#: Confidences of orders 2 and 1, and whether both name the same id.
STATES = 2 * (SURE + 1) ** 2
#: Bits of the shares of the three orders in a state, and of the order-0 frequencies.
WAY_BITS, ID_BITS = 12, 18
ALL = 1 << (WAY_BITS + ID_BITS)
#: Different ids that order 0 gives a frequency each; the rest share one and store their bits.
NAMED = 1 << 16
#: What ids are multiplied by to find their contexts.
MIX = 0x9E3779B1
#: Steps of a group whose contexts or shares are looked up at once.
CHUNK = 8
#: Ids below this are looked up in a table.
SMALL = 1 << 20
#: The coder keeps 48 bits and gives out 16 at a time once the range is below LEAST.
FULL, LEAST = (1 << 48) - 1, 1 << 32


class CorruptBlock(ValueError):
    """A block whose ids do not match its checksum."""


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """Counts as whole frequencies that add up to ``total``; what was counted keeps one at least."""
    seen = counts > 0
    if not seen.any():
        return np.zeros(len(counts), dtype=np.int64)
    out = seen + (counts * ((total - int(seen.sum())) / counts.sum())).astype(np.int64)
    out[np.argmax(out)] += total - int(out.sum())
    return out


@dataclass
class Odds:
    """What a group of blocks shares: how often each id comes, and how far each order is to be trusted.

    ``ways`` has a row per state with the shares of orders 2, 1 and 0; ``ids`` are ascending, ``counts``
    their order-0 frequencies after that of all other ids, which stands first.
    """

    ways: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    @classmethod
    def even(cls) -> Odds:
        """Nothing known: trust by hits in a row, and the same chance for every id."""
        level = (2 * np.arange(SURE + 1) + 1) / (2 * SURE + 2)
        state = np.arange(STATES)
        two, one, agree = level[state >> 3 & SURE], level[state & SURE], state >> 6
        rest = (1 - two) * one * (1 - agree)
        ways = np.stack((two, rest, 1 - two - rest), axis=1)
        return cls.fit(ways * (1 << WAY_BITS), np.zeros(0, dtype=np.int64), np.array([1]))

    @classmethod
    def fit(cls, ways: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> Odds:
        """From numbers of times; order 0 is possible in every state."""
        ways = ways.astype(np.int64) + np.array([0, 0, 1])
        if len(ids) > NAMED:
            kept = np.sort(np.argsort(-counts[1:], kind="stable")[:NAMED])
            others = int(counts.sum()) - int(counts[1:][kept].sum())
            ids, counts = ids[kept], np.concatenate(([others], counts[1:][kept]))
        if not counts.any():
            counts = np.array([1])
        return cls(
            np.array([_shares(w, 1 << WAY_BITS) for w in ways]),
            ids.astype(np.int64),
            _shares(counts, 1 << ID_BITS),
        )

    def pack(self) -> bytes:
        gaps = np.diff(self.ids, prepend=0).astype("<u4")
        parts = (self.ways.astype("<u2")[:, :2], gaps, self.counts.astype("<u4"))
        # Bytes of equal rank side by side, as most of the high ones are zero.
        planes = b"".join(np.ascontiguousarray(p).ravel().view("u1").reshape(-1, p.itemsize).T.tobytes() for p in parts)
        return struct.pack("<I", len(self.ids)) + zlib.compress(planes, 1)

    @classmethod
    def unpack(cls, data: bytes) -> Odds:
        (n,) = struct.unpack_from("<I", data)
        planes = np.frombuffer(zlib.decompress(data[4:]), dtype="u1")
        ends = np.cumsum([0, STATES * 4, n * 4, n * 4 + 4])
        ways, gaps, counts = (
            np.ascontiguousarray(planes[a:b].reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.int64)
            for a, b, width in zip(ends[:-1], ends[1:], (2, 4, 4), strict=True)
        )
        ways = ways.reshape(STATES, 2)
        return cls(np.column_stack((ways, (1 << WAY_BITS) - ways.sum(axis=1))), np.cumsum(gaps), counts)


class _Shares:
    """The odds as the coders use them: where a choice begins in the range, and its size."""

    def __init__(self, odds: Odds):
        self.odds = odds
        ways = odds.ways << ID_BITS
        self.one, self.zero = ways[:, 0].copy(), ways[:, 0] + ways[:, 1]
        self.unit = odds.ways[:, 2].copy()
        # Order 2 begins at 0, order 1 after it; order 0 is a stretch of units dealt out by the frequencies.
        none = np.zeros_like(self.one)
        self.way_begin = np.stack((self.zero, self.one, none, none), axis=1).ravel()
        self.way_size = np.stack((self.unit, ways[:, 1], ways[:, 0], ways[:, 0]), axis=1).ravel()
        # The last symbol stands for an id that order 0 need not name.
        self.size = np.concatenate((odds.counts, [1]))
        self.begin = np.concatenate((np.cumsum(odds.counts) - odds.counts, [0]))
        self.others = bool(odds.counts[0])
        #: The place of each id among the named ones, from 1, where ids are small.
        self.place = None
        if not len(odds.ids) or int(odds.ids[-1]) < SMALL:
            self.place = np.zeros(SMALL + 1, dtype=np.int32)
            self.place[odds.ids] = np.arange(1, len(odds.ids) + 1)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Places of ids in ``size`` and ``begin``: 0 for those without a frequency of their own."""
        if self.place is not None:
            return self.place.take(ids, mode="clip")
        at = np.searchsorted(self.odds.ids, ids)
        return np.where(self.odds.ids.take(at, mode="clip") == ids, at + 1, 0)


class _Model:
    """Predictions of orders 2 and 1 for a group of blocks; state starts anew for each block.

    They predict the id that last followed the same two ids or the same one, order 0 a distribution
    over all ids.  The three are mixed by shares that depend on how sure orders 2 and 1 are, as
    :class:`Odds` has them.  Both orders are looked up and learn side by side, in rows 0 and 1.
    """

    def __init__(self, lanes: int, bits: int):
        lane = np.arange(lanes)
        self.first = np.stack((lane * SLOTS_2, lanes * SLOTS_2 + lane * SLOTS_1))
        self.mask = np.array([[SLOTS_2 - 1], [SLOTS_1 - 1]])
        #: The last id seen after each context, and how sure it is (the low 3 bits).
        self.entry = np.zeros(lanes * (SLOTS_1 + SLOTS_2), dtype=np.int32 if bits <= 16 else np.int64)
        self.mixed = np.zeros(lanes, dtype=np.int64)
        self.before = np.zeros(lanes, dtype=np.int64)

    def look(self, n: int) -> np.ndarray:
        """The states of the first ``n`` lanes; the guesses are kept."""
        mixed = self.mixed[:n]
        at = np.empty((2, n), dtype=np.int64)
        np.add(mixed, self.before[:n], out=at[0])
        at[1] = mixed
        at >>= 9
        at &= self.mask
        at += self.first[:, :n]
        return self._states(*self._see(at))

    def learn(self, actual: np.ndarray) -> None:
        """Take the ids that came."""
        n = len(actual)
        self._hits(actual.astype(self.entry.dtype))
        # Consecutive ids count differently: the one before last by another multiple.
        np.right_shift(self.mixed[:n], 3, out=self.before[:n])
        np.multiply(actual, MIX, out=self.mixed[:n])

    def ways(self, actual: np.ndarray) -> np.ndarray:
        """Take the ids of some steps, all lanes each: four times the state, and who predicts the id.

        That is 1 for order 1 alone, 2 or 3 for order 2, 0 for neither.
        """
        steps = len(actual)
        mixed = np.concatenate((self.mixed[None], actual * np.int64(MIX)))
        at = np.empty((steps, *self.first.shape), dtype=np.int64)
        at[:, 0] = at[:, 1] = mixed[:-1]
        at[0, 0] += self.before
        at[1:, 0] += mixed[:-2] >> 3
        at >>= 9
        at &= self.mask
        at += self.first
        self.before, self.mixed = mixed[-2] >> 3, mixed[-1]
        new = actual.astype(self.entry.dtype)
        seen = [(*self._see(at[t]), self._hits(new[t])) for t in range(steps)]
        guess, level, hit = (np.stack(part, axis=1) for part in zip(*seen, strict=True))
        ways = self._states(guess, level).astype(np.int16) << 2
        ways += (hit[0] << 1) + hit[1]
        return ways

    def _see(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = self.entry.take(at)
        self.at, self.guess, self.level = at, packed >> 3, (packed & SURE).astype(np.int8)
        return self.guess, self.level

    @staticmethod
    def _states(guess: np.ndarray, level: np.ndarray) -> np.ndarray:
        state = (guess[0] == guess[1]).view(np.int8) << 6
        state += level[0] << 3
        state += level[1]
        return state

    def _hits(self, new: np.ndarray) -> np.ndarray:
        """A hit raises the confidence by one and a miss halves it; an unsure guess that missed gives way.

        Products with 0 or 1 choose, as numpy is slower at choosing by a mask.
        """
        missed = self.guess != new
        hit = (~missed).view(np.int8)
        low = self.level >> 1
        level = self.level + (self.level < SURE)
        level -= low
        level *= hit
        level += low
        kept = new - self.guess
        kept *= (self.level < 2) & missed
        kept += self.guess
        kept <<= 3
        kept += level
        self.entry[self.at] = kept
        return hit


class _Encoder:
    """Low end and range of each lane in whole numbers; carries are settled at the end."""

    def __init__(self, lanes: int, room: int):
        self.lanes = np.arange(lanes)
        self.low = np.zeros(lanes, dtype=np.int64)
        self.range = np.full(lanes, FULL, dtype=np.int64)
        self.out = np.zeros(room * lanes, dtype=np.uint32)  # step by step, all lanes side by side
        self.at = np.arange(lanes)  # where the next 16 bits of a lane go

    def narrow(self, n: int, begin: np.ndarray, size: np.ndarray) -> None:
        """Go on to a part of the range, given in parts of ALL."""
        width = self.range[:n]
        unit = width >> (WAY_BITS + ID_BITS)
        self.low[:n] += begin * unit
        np.multiply(size, unit, out=width)
        self._shift(slice(0, n), width < LEAST)
        again = width < LEAST
        if again.any():  # at most 30 bits are taken at once
            few = np.flatnonzero(again)
            self._shift(few, again[few])

    def plain(self, lanes: np.ndarray, value: np.ndarray) -> None:
        """Code 16 bits as they are."""
        unit = self.range[lanes] >> 16
        self.low[lanes] += value * unit
        self.range[lanes] = unit
        self._shift(lanes, unit < LEAST)

    def _shift(self, lanes, small: np.ndarray) -> None:
        low, given = self.low[lanes], small.astype(np.int64)
        top = low >> 32
        # What is no 16 bits yet is written over by what comes next.
        self.out[self.at[lanes]] = top
        self.at[lanes] += given * len(self.lanes)
        top *= given
        top <<= 32
        given <<= 4
        self.low[lanes] = (low - top) << given
        self.range[lanes] <<= given

    def finish(self) -> list[bytes]:
        count = len(self.lanes)
        for _ in range(3):
            self._shift(self.lanes, np.ones(count, dtype=bool))
        lengths = self.at // count
        words = self.out[: int(lengths.max()) * count].reshape(-1, count)
        words[lengths.min() :][np.arange(lengths.min(), len(words))[:, None] >= lengths] = 0
        for row in range(len(words) - 1, 0, -1):
            words[row - 1] += words[row] >> 16
        plain = words.T.astype("<u2")
        return [plain[i, :n].tobytes() for i, n in enumerate(lengths)]


class _Decoder:
    """Distance of the code from the low end, and the range, as whole numbers below 2^53 in floats.

    Every product is exact, and a quotient below 2^30 by less than 2^18 rounds down to the right number,
    also once less a whole number and divided by one below 2^12.
    """

    def __init__(self, payloads: list[bytes]):
        count = len(payloads)
        words = [np.frombuffer(p, dtype="<u2") for p in payloads]
        longest = max((len(w) for w in words), default=0) + 4
        rows = np.zeros((count, longest), dtype=np.uint16)
        for i, w in enumerate(words):
            rows[i, : len(w)] = w
        self.words = rows.T.copy().ravel()
        self.count = count
        first = self.words[: 3 * count].reshape(3, count).astype(np.float64)
        self.code = (first[0] * 65536 + first[1]) * 65536 + first[2]
        self.range = np.full(count, float(FULL))
        self.at = np.arange(count) + 3 * count

    def spot(self, n: int) -> np.ndarray:
        """Where the code lies in the range, in parts of ALL."""
        self.unit = np.floor(self.range[:n] * (1.0 / ALL))
        # A damaged block may lie beyond; the checksum tells.
        return np.minimum(self.code[:n] / self.unit, ALL - 1)

    def narrow(self, n: int, begin: np.ndarray, size: np.ndarray) -> None:
        self.code[:n] -= begin * self.unit
        self.range[:n] = size * self.unit
        self._shift(slice(0, n))
        again = self.range[:n] < LEAST
        if again.any():
            self._shift(np.flatnonzero(again))

    def plain(self, lanes: np.ndarray) -> np.ndarray:
        unit = np.floor(self.range[lanes] * (1.0 / 65536))
        value = np.minimum(np.floor(self.code[lanes] / unit), 65535)
        self.code[lanes] -= value * unit
        self.range[lanes] = unit
        self._shift(lanes)
        return value.astype(np.int64)

    def _shift(self, lanes) -> None:
        small = self.range[lanes] < LEAST
        times = small * 65535.0
        times += 1.0
        word = self.words.take(self.at[lanes], mode="clip")
        word *= small
        self.code[lanes] = self.code[lanes] * times + word
        self.range[lanes] *= times
        self.at[lanes] += small * self.count


def id_bits(ids: np.ndarray) -> int:
    """Bits that the largest id needs, in steps of 16: a property of the file, kept in it."""
    return 16 if not len(ids) or int(ids.max()) < 1 << 16 else 32


def _columns(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all blocks step by step, and the sizes of the blocks."""
    count = -(-len(ids) // BLOCK)
    sizes = np.full(count, BLOCK)
    sizes[-1] = len(ids) - BLOCK * (count - 1)
    stream = np.zeros(count * BLOCK, dtype=np.uint32)
    stream[: len(ids)] = ids
    return stream.reshape(count, BLOCK).T.copy(), sizes


def _predicted(columns: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """For each id of ``columns``: four times the state, and who predicts it."""
    out = np.zeros(columns.shape, dtype=np.int16)
    model = _Model(len(sizes), bits)
    steps = int(sizes.max())
    for t in range(0, steps, CHUNK):  # what follows the end of a lane is of no matter
        out[t : min(t + CHUNK, steps)] = model.ways(columns[t : min(t + CHUNK, steps)])
    return out


def _fitted(columns: np.ndarray, sizes: np.ndarray, ways: np.ndarray) -> Odds:
    real = np.arange(len(columns))[:, None] < sizes
    left = columns[real & (ways & 3 == 0)]
    if len(left) and int(left.max()) < SMALL:
        counts = np.bincount(left)
        ids = np.flatnonzero(counts)
        counts = counts[ids]
    else:
        ids, counts = np.unique(left, return_counts=True)
    zero, one, two, both = np.bincount(ways[real], minlength=STATES * 4).reshape(STATES, 4).T
    return Odds.fit(np.stack((two + both, one, zero), axis=1), ids, np.concatenate(([0], counts)))


def encode_fitted(ids: np.ndarray, bits: int) -> tuple[Odds, list[tuple[int, int, bytes]]]:
    """Odds made for an id stream, which decoding needs, and its blocks."""
    if not len(ids):
        return Odds.even(), []
    columns, sizes = _columns(ids)
    ways = _predicted(columns, sizes, bits)
    odds = _fitted(columns, sizes, ways)
    return odds, _coded(ids, columns, sizes, ways, bits, odds)


def encode(ids: np.ndarray, bits: int, odds: Odds | None = None) -> list[tuple[int, int, bytes]]:
    """Blocks of an id stream: number of ids, crc32 of the ids as 32-bit little endian, payload."""
    if not len(ids):
        return []
    columns, sizes = _columns(ids)
    return _coded(ids, columns, sizes, _predicted(columns, sizes, bits), bits, odds or Odds.even())


def _coded(ids, columns, sizes, ways, bits: int, odds: Odds) -> list[tuple[int, int, bytes]]:
    shares, count = _Shares(odds), len(sizes)
    coder = _Encoder(count, BLOCK * (2 + bits // 16) + 8)
    for t in range(int(sizes.max())):
        if t % CHUNK == 0:  # what needs no coder, for some steps at once
            way, actual = ways[t : t + CHUNK], columns[t : t + CHUNK]
            begins, widths = shares.way_begin.take(way), shares.way_size.take(way)
            symbols = np.where(way & 3, len(shares.size) - 1, shares.find(actual))
            begins += shares.begin.take(symbols) * widths
            widths *= shares.size.take(symbols)
        live, row = count if t < sizes[-1] else count - 1, t % CHUNK
        coder.narrow(live, begins[row, :live], widths[row, :live])
        if shares.others and len(other := np.flatnonzero(symbols[row, :live] == 0)):
            for low in range(0, bits, 16):
                coder.plain(other, actual[row, other].astype(np.int64) >> low & 0xFFFF)
    payloads = coder.finish()
    plain = ids.astype("<u4")
    return [
        (int(n), zlib.crc32(plain[i * BLOCK : i * BLOCK + int(n)].tobytes()), payloads[i])
        for i, n in enumerate(sizes)
    ]


def decode(blocks: list[tuple[int, int, bytes]], bits: int, odds: Odds | None = None) -> np.ndarray:
    """The ids of blocks (any of them, in any order), checked against their checksums."""
    if not blocks:
        return np.zeros(0, dtype="<u4")
    sizes = np.array([b[0] for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    odds = odds or Odds.even()
    shares, model, coder = _Shares(odds), _Model(len(blocks), bits), _Decoder([blocks[i][2] for i in order])
    ids = np.concatenate(([0], odds.ids))
    symbols = np.repeat(np.arange(len(odds.counts), dtype=np.int32), odds.counts)
    # In floats, as the decoder's numbers are.
    begins, widths = shares.begin.astype(np.float64), shares.size.astype(np.float64)
    ones, zeros, units = (a.astype(np.float64) for a in (shares.one, shares.zero, shares.unit))
    ranked = sizes[order]
    lives = np.searchsorted(-ranked, -np.arange(int(ranked[0])), side="left")
    columns = np.zeros((len(lives), len(blocks)), dtype="<u4")
    with np.errstate(over="ignore"):  # a damaged block may run away
        for t, live in enumerate(lives.tolist()):
            state = model.look(live).astype(np.int64)
            spot = coder.spot(live)
            one, zero, unit = ones.take(state), zeros.take(state), units.take(state)
            not_zero, by_two = spot < zero, spot < one
            spot -= zero
            spot /= unit
            symbol = symbols.take(spot.astype(np.int64), mode="clip").astype(np.int64)
            begin, size, found = begins.take(symbol), widths.take(symbol), ids.take(symbol)
            begin *= unit
            begin += zero
            size *= unit
            few = np.flatnonzero(not_zero)
            begin[few], size[few], found[few] = one[few], zero[few] - one[few], model.guess[1][few]
            few = np.flatnonzero(by_two)
            begin[few], size[few], found[few] = 0.0, one[few], model.guess[0][few]
            coder.narrow(live, begin, size)
            if shares.others and len(other := np.flatnonzero((symbol == 0) > not_zero)):
                found[other] = sum(coder.plain(other) << low for low in range(0, bits, 16))
            model.learn(found)
            columns[t, :live] = found
    out: list[np.ndarray] = [np.zeros(0, dtype="<u4")] * len(blocks)
    stream = columns.T.copy()
    for lane, i in enumerate(order):
        part = stream[lane, : sizes[i]]
        if zlib.crc32(part.tobytes()) != blocks[i][1]:
            raise CorruptBlock(f"block {i} does not match its checksum")
        out[i] = part
    return np.concatenate(out)
