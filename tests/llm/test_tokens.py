"""The coder of token files: odds of a group, and fewer bits than order 0 alone."""

from __future__ import annotations

import io

import numpy as np
import pytest

from marquee.llm import rangecoder, tokens


def zipf(n: int, most: int) -> np.ndarray:
    return np.minimum(np.random.default_rng(n).zipf(1.3, n), most).astype(np.int64)


def order_0(ids: np.ndarray) -> float:
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(share * np.log2(share)).sum())


def test_real_order_0_counts():
    rng = np.random.default_rng(5)
    share = (1.0 + np.arange(600)) ** -0.7
    ids = rng.choice(rng.integers(0, 49_000, 600), 120_000, p=share / share.sum())
    odds, blocks = rangecoder.encode_fitted(ids, 16)
    size = len(odds.pack()) + sum(len(b[2]) for b in blocks)
    assert 8 * size / len(ids) < 1.05 * order_0(ids)
    odds = rangecoder.Odds.unpack(odds.pack())
    assert (rangecoder.decode(blocks, 16, odds) == ids).all()
    assert (rangecoder.decode(blocks[3:4], 16, odds) == ids[3 * 4096 : 4 * 4096]).all()  # blocks stand alone
    first = rangecoder.encode(ids[:4096], 16, odds)[0]
    assert first == blocks[0]  # whatever blocks are coded with it


@pytest.mark.parametrize("most", [1, 2, 300, 1 << 16, 1 << 21, 1 << 32])
@pytest.mark.parametrize("n", [0, 1, 4097, 90_000])
def test_fitted_round_trip(n, most):
    ids = np.random.default_rng(n).integers(0, most, n)
    bits = rangecoder.id_bits(ids)
    odds, blocks = rangecoder.encode_fitted(ids, bits)
    assert (rangecoder.decode(blocks, bits, rangecoder.Odds.unpack(odds.pack())) == ids).all()


def test_more_ids_than_are_named(monkeypatch):
    monkeypatch.setattr(rangecoder, "NAMED", 100)
    for most in (5_000, 1 << 30):
        ids = np.concatenate((zipf(9_000, 50), np.random.default_rng(1).integers(0, most, 9_000)))
        bits = rangecoder.id_bits(ids)
        odds, blocks = rangecoder.encode_fitted(ids, bits)
        assert len(odds.ids) == 100 and odds.counts[0] > 0
        assert (rangecoder.decode(blocks, bits, odds) == ids).all()


class Stream(io.BytesIO):
    def size(self) -> int:
        return len(self.getvalue())

    def close(self) -> None:
        pass


def test_groups_of_a_file():
    sizes = np.array([5_000, 0, 1, 9_000, 2_500])
    ids = zipf(int(sizes.sum()), 60_000)
    out = Stream()
    writer = tokens.Writer(out, block_group=2)
    for k, part in enumerate(np.split(ids, np.cumsum(sizes)[:-1])):
        writer.add(np.array([k]), sizes[k : k + 1], part)
    writer.close()
    (keys, found, _), *parts = tokens.read_file(out)
    assert keys.tolist() == [*range(5)] and (found == sizes).all()
    assert len(parts) == 3 and (np.concatenate([p[2] for p in parts]) == ids).all()
    for at in (len(tokens.MAGIC) + 30, len(out.getvalue()) // 2):
        data = bytearray(out.getvalue())
        data[at] ^= 1
        with pytest.raises(rangecoder.CorruptBlock):
            list(tokens.read_file(Stream(bytes(data))))
