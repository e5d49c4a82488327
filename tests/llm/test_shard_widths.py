import struct
import tracemalloc

import numpy as np

from gridloom.llm.tokenbin import BLOCK, decode_shard, encode_shard


def plain_ids(payload):
    """The ids of a shard, bit by bit as the format says."""
    n, block, n_blocks = struct.unpack_from("<III", payload, 4)
    starts = struct.unpack_from(f"<{n_blocks + 1}I", payload, 16)
    out = []
    for start in starts[:-1]:
        at = 16 + 4 * (n_blocks + 1) + start
        low, width, k = struct.unpack_from("<IBH", payload, at)
        at += 7
        bits = int.from_bytes(payload[at : at + block // 8 * width], "little")
        values = [bits >> i * width & (1 << width) - 1 for i in range(block)]
        at += block // 8 * width
        for where, high in zip(struct.unpack_from(f"<{k}H", payload, at), struct.unpack_from(f"<{k}I", payload, at + 2 * k)):
            values[where] |= high << width
        out += [low + v for v in values]
    return out[:n]


def test_shards_hold_what_the_format_says_at_every_width():
    draw = np.random.default_rng(3)
    for width in range(33):
        ids = draw.integers(0, 1 << width, 3 * BLOCK // 2, dtype=np.uint64).astype(np.uint32)
        ids[::50] = draw.integers(0, 1 << 32, len(ids[::50]), dtype=np.uint64)
        payload = encode_shard(ids)
        assert plain_ids(payload) == ids.tolist() == decode_shard(payload).tolist()


def test_a_shard_is_worked_in_32_bits():
    ids = np.random.default_rng(4).integers(0, 50_000, 1 << 20, dtype=np.uint32)
    payload = encode_shard(ids)
    peaks = []
    for work in (lambda: encode_shard(ids), lambda: decode_shard(payload)):
        tracemalloc.start()
        work()
        peaks.append(tracemalloc.get_traced_memory()[1] / len(ids))
        tracemalloc.stop()
    assert peaks[0] < 22 and peaks[1] < 12, peaks
