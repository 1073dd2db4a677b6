"""Static range asymmetric numeral system over token ids.

A file image holds one table of symbol frequencies (summing to 2**bits), documents (ids and lengths), checkpoints
and blocks. A block has its own word stream and 64 interleaved 64-bit states, so blocks decode independently:
a checkpoint gives a block's place, its symbols and its CRC-32. Blocks are coded side by side with numpy.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"IRNS"
LANES, STEPS = 64, 256
BLOCK = LANES * STEPS
LOW = np.uint64(1 << 31)
TABLE_IDS = 1 << 20  # smaller ids are counted by a table, others by sorting
_HEAD = struct.Struct("<4sHHIQQIIII")  # magic, version, bits, table bytes, symbols, documents, document bytes, blocks, reserved, crc of all before the blocks
_POINT = np.dtype([("at", "<u8"), ("words", "<u4"), ("symbols", "<u4"), ("crc", "<u4")])


def frequencies(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies of at least 1 in proportion to the counts, summing to 2**bits."""
    f = 1 + counts * ((1 << bits) - len(counts)) // counts.sum()
    f[np.argmax(f)] += (1 << bits) - f.sum()
    return f.astype(np.uint64)


def alphabet(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in order, the place of each id among them, and their counts."""
    if ids.max() >= TABLE_IDS:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[symbols] = np.arange(len(symbols))
    return symbols, place[ids], counts[symbols]


def encode(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """File image of the ids of documents. ids is not empty."""
    symbols, index, counts = alphabet(ids)
    bits = max(18, int(len(symbols) - 1).bit_length() + 2)
    freq = frequencies(counts.astype(np.int64), bits)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, np.int32)
    padded[: len(ids)] = index
    grid = np.ascontiguousarray(padded.reshape(n, STEPS, LANES).transpose(1, 0, 2)).reshape(STEPS, n * LANES)
    x = np.full(n * LANES, LOW, np.uint64)
    lanes, words = [], []
    b, most = np.uint64(bits), (LOW >> np.uint64(bits)) << np.uint64(32)
    for t in range(STEPS - 1, -1, -1):
        f = freq[grid[t]]
        out = np.flatnonzero(x >= most * f)
        lanes.append(out.astype(np.int32))
        words.append((x[out] & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        x[out] >>= np.uint64(32)
        whole = x // f
        x = (whole << b) + (x - whole * f) + cum[grid[t]]
    block = np.concatenate(lanes[::-1]) // LANES
    order = np.argsort(block.astype(np.min_scalar_type(n)), kind="stable")  # few bits are sorted by radix
    stream = np.concatenate(words[::-1])[order]
    ends = np.cumsum(np.bincount(block, minlength=n))
    points, body, at = np.zeros(n, _POINT), [], 0
    for k in range(n):
        own = x[k * LANES : (k + 1) * LANES].astype("<u8").tobytes() + stream[(ends[k - 1] if k else 0) : ends[k]].astype("<u4").tobytes()
        points[k] = (at, (len(own) - 8 * LANES) // 4, min(BLOCK, len(ids) - k * BLOCK), zlib.crc32(own))
        body.append(own)
        at += len(own)
    shared = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 1)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = zlib.compress(known.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(lengths).astype("<u8").tobytes(), 1)
    head = _HEAD.pack(MAGIC, 1, bits, len(shared), len(ids), len(doc_ids), len(docs), n, 0, 0)[:-4]
    before = shared + docs + points.tobytes()
    return head + struct.pack("<I", zlib.crc32(head + before)) + before + b"".join(body)


class Image:
    """Reads a file image; blocks can be decoded one by one or side by side."""

    def __init__(self, data: bytes):
        magic, version, self.bits, table, self.symbols, self.documents, docs, self.blocks, _, crc = _HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.body = at + table + docs + self.blocks * _POINT.itemsize
        if zlib.crc32(data[: at - 4] + data[at : self.body]) != crc:
            raise ValueError("the header is damaged")
        self.data = data
        shared = np.frombuffer(zlib.decompress(data[at : at + table]), "<u4")
        self.alphabet = np.cumsum(shared[: len(shared) // 2], dtype=np.uint32)
        self.freq = shared[len(shared) // 2 :].astype(np.uint64)
        raw = zlib.decompress(data[at + table : at + table + docs])
        n = self.documents
        known = np.frombuffer(raw, np.uint8, n)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(raw, "<i8", n, n), known, strict=True)]
        self.lengths = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        self.points = np.frombuffer(data, _POINT, self.blocks, at + table + docs)

    def decode(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of blocks first to last (exclusive; None: all), checked against their checksums."""
        points = self.points[first:last]
        n = len(points)
        x, streams = np.empty((n, LANES), np.uint64), []
        for k, p in enumerate(points):
            own = self.data[self.body + int(p["at"]) : self.body + int(p["at"]) + 8 * LANES + 4 * int(p["words"])]
            if zlib.crc32(own) != p["crc"]:
                raise ValueError(f"block {first + k} is damaged")
            x[k] = np.frombuffer(own, "<u8", LANES)
            streams.append(np.frombuffer(own, "<u4", offset=8 * LANES))
        stream = np.concatenate([*streams, np.zeros(1, np.uint32)]).astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(points["words"].astype(np.int64))[:-1]])
        cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        slots = np.repeat(np.arange(len(self.freq), dtype=np.int32), self.freq.astype(np.int64))
        out = np.empty((STEPS, n, LANES), np.int32)
        mask, b = np.uint64((1 << self.bits) - 1), np.uint64(self.bits)
        for t in range(STEPS):
            slot = x & mask
            s = slots[slot.astype(np.int64)]
            out[t] = s
            x = self.freq[s] * (x >> b) + slot - cum[s]
            low = x < LOW
            place = at[:, None] + np.cumsum(low, axis=1) - 1
            x = np.where(low, (x << np.uint64(32)) | stream[np.where(low, place, -1)], x)
            at = at + low.sum(1)
        flat = out.transpose(1, 0, 2).reshape(n, BLOCK)
        ids = self.alphabet[flat.ravel()]
        return ids[: int(points["symbols"].sum())]
