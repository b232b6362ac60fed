"""Words of many texts at once: their places and hashes as numpy arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tessera.llm.bloom import mix

#: Bytes of text worked on at once; longer pieces only where one line is longer.
PIECE = 1 << 20
#: Bytes hashed at once, and the base of candidates' keys (odd, so that it has an inverse modulo 2^64).
BLOCK, BASE = 1 << 18, 0x9E3779B97F4A7C15
#: Places in a word whose bytes' mixed values are looked up instead of computed.
PLACES = 256
_MIXED = mix(np.arange(PLACES << 8, dtype=np.uint64))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: ASCII lower case; white space becomes a space, all else stays.
PLAIN = bytes(32 if c in b" \t\n\v\f\r" else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0 .. BASE^(n-1) and their inverses modulo 2^64, at least n of them."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        if size > BLOCK:
            _POWERS.pop(next((s for s in _POWERS if s > BLOCK), None), None)
        inverse = pow(BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS[size] = tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (BASE, inverse))
    return _POWERS[size]


def word_places(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than spaces and line ends."""
    inner = np.concatenate(([False], (u != 32) & (u != 10), [False]))
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    return edges[::2], edges[1::2]


def hashes(u: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, the same wherever it stands: its bytes, each mixed with its place in the word, summed and mixed.

    A sum of powers would give words of a regular build (Thue-Morse) one hash.
    """
    out = np.empty(len(starts), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, "right")))
            size = ends[a:b] - starts[a:b]
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum()))
            inside = place - np.repeat(first, size)
            byte = inside << 8 | u[inside + np.repeat(starts[a:b], size)]
            value = _MIXED[byte & ((PLACES << 8) - 1)]
            if size.max() > PLACES:
                far = np.flatnonzero(inside >= PLACES)
                value[far] = mix(byte[far].astype(np.uint64))
            out[a:b] = mix(np.add.reduceat(value, first) + size.astype(np.uint64))
            a = b
    return out


def sequence_hashes(h: np.ndarray, first: np.ndarray, place: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each run of word hashes that begins at `first` and has n words; place: each word's in its run."""
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(mix(h + mix(place.astype(np.uint64) + np.uint64(1))), first) + n.astype(np.uint64))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words of one array; the array's own length less width - 1."""
    n = len(h) - width + 1
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for k in range(1, width):
            out = mix(out) + h[k : k + n]
    return mix(out)


def groups(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes of text, a longer text alone."""
    if not len(column):
        return
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_string(column.type) or pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1])
    a = held = 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(column):
        yield a, len(column)


def raw(column: pa.Array, a: int, b: int) -> list[bytes]:
    """The bytes of rows a to b; none for null."""
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column[a:b]]


def words_of(texts: list[bytes], table: bytes = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many each text has; a long text in pieces."""
    found, counts = [], []
    a = 0
    while a < len(texts):
        b, held = a + 1, len(texts[a])
        while b < len(texts) and held + len(texts[b]) <= PIECE:
            held += len(texts[b])
            b += 1
        u = np.frombuffer(b" ".join(texts[a:b]).translate(table), np.uint8)
        starts, ends = word_places(u)
        found.append(hashes(u, starts, ends))
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        counts.append(np.diff(np.searchsorted(starts, bounds)))
        a = b
    return (np.concatenate(found), np.concatenate(counts)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def votes(h: np.ndarray, owner: np.ndarray, owners: int, tables: int, block: int = 8192) -> np.ndarray:
    """[owner, 64 * tables]: how many of its words have each bit set; owner is ascending."""
    out = np.zeros((owners, 64 * tables), np.int32)
    with np.errstate(over="ignore"):
        for a in range(0, len(h), block):
            part, own = h[a : a + block], owner[a : a + block]
            seeds = np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
            bits = np.unpackbits(mix(part[:, None] + seeds).view(np.uint8).ravel()).view(np.uint64).reshape(len(part), -1)
            # eight one-byte sums in each uint64; those of up to 255 words fit
            at = np.union1d(np.flatnonzero(np.diff(own, prepend=-1)), np.arange(0, len(part), 255))
            sums = np.add.reduceat(bits, at, axis=0).view(np.uint8)
            first = np.flatnonzero(np.diff(own[at], prepend=-1))
            out[own[at[first]]] += np.add.reduceat(sums, first, axis=0, dtype=np.int32)
    return out
