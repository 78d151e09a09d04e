"""A file of token ids in fixed-width bits, with random access.

Layout (all numbers little-endian)::

    blocks      BLOCK ids each (the last one fewer), every id in ``width`` bits, low bits first; a block fills whole bytes
    offsets     uint64 x (blocks + 1): byte at which each block starts, and the end of the last
    docs        int64 x docs: the ids of the documents, in the order of the file
    nulls       one byte a document: 1 where the document has no id
    starts      uint64 x (docs + 1): ids before each document, and all ids
    footer      magic, width, block size, docs, ids

A reader needs the footer, then seeks: an id lies in block ``i // BLOCK`` at bit ``(i % BLOCK) * width``.  Packing and
unpacking are numpy expressions over whole blocks; no loop runs over ids.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"TSIDBITS"
FOOTER = struct.Struct("<8sIIQQ")
BLOCK = 1 << 16


def width_of(vocabulary: int) -> int:
    """Bits that the largest of ``vocabulary`` ids (0 to vocabulary - 1) needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``ids`` in ``width`` (1 to 32) bits each, low bits first, padded to whole bytes."""
    bits = np.unpackbits(np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(data: bytes, first: int, n: int, width: int) -> np.ndarray:
    """``n`` ids from id ``first`` of packed ``data``: eight bytes are read at the byte of each id, shifted and masked."""
    at = np.arange(first, first + n, dtype=np.int64) * width
    whole = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.ndarray(len(whole) - 7, "<u8", whole, strides=(1,))
    return (eight[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Writer:
    """Appends documents to a binary stream; holds one block of ids and 17 bytes a document."""

    def __init__(self, out, width: int, block: int = BLOCK):
        self.out, self.width, self.block = out, width, block
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.at = 0
        self.offsets, self.docs, self.nulls, self.starts = [0], [], bytearray(), [0]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> self.width:
            raise ValueError(f"an id needs more than {self.width} bits")
        self.docs.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.ids += len(ids)
        self.starts.append(self.ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(self.held // self.block * self.block)

    def _flush(self, n: int) -> None:
        held = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        for k in range(0, n, self.block):
            data = pack(held[k:min(k + self.block, n)], self.width)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.waiting, self.held = [held[n:]], self.held - n

    def close(self) -> None:
        self._flush(self.held)
        for x, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, np.uint8), (self.starts, "<u8")):
            self.out.write(np.array(x, kind).tobytes())
        self.out.write(FOOTER.pack(MAGIC, self.width, self.block, len(self.docs), self.ids))
        self.out.close()


class Reader:
    """Random access to a file of :class:`Writer` through a seekable binary stream."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        end = stream.tell() - FOOTER.size
        magic, self.width, self.block, docs, self.n_ids = FOOTER.unpack(self._bytes(end, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no file of packed ids")
        blocks = -(-self.n_ids // self.block)
        at = end - 8 * (docs + 1) - docs - 8 * docs - 8 * (blocks + 1)
        index = self._bytes(at, end - at)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * (blocks + 1))
        self.nulls = np.frombuffer(index, np.uint8, docs, 8 * (blocks + 1 + docs)).astype(bool)
        self.starts = np.frombuffer(index, "<u8", docs + 1, 8 * (blocks + 1 + docs) + docs).astype(np.int64)

    def _bytes(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids ``first`` to ``last - 1`` of the file; only their blocks are read."""
        parts = []
        for b in range(first // self.block, -(-last // self.block)):
            lo, hi = max(first, b * self.block), min(last, (b + 1) * self.block)
            data = self._bytes(int(self.offsets[b]), int(self.offsets[b + 1] - self.offsets[b]))
            parts.append(unpack(data, lo - b * self.block, hi - lo, self.width))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """All ids of the document at place ``k``."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))

    def stretches(self) -> Iterator[tuple[int, np.ndarray]]:
        """(document, ids) in order; a document that goes over a block's end comes in several stretches, an empty one in one."""
        data, held = b"", -1
        for k in range(len(self.doc_ids)):
            at, end = int(self.starts[k]), int(self.starts[k + 1])
            if at == end:
                yield k, np.zeros(0, np.uint32)
            while at < end:
                b = at // self.block
                if b != held:
                    data, held = self.ids(b * self.block, min((b + 1) * self.block, self.n_ids)), b
                stop = min(end, (b + 1) * self.block)
                yield k, data[at - b * self.block:stop - b * self.block]
                at = stop
