"""Arrays of numbers as short byte strings, for rows that Spark deals and keeps without looking into them."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

#: Bytes of a number (0: floats), whether steps are kept in place of numbers, how many there are, the first or least.
_HEAD = struct.Struct("<BBqq")
_CODEC = pa.Codec("zstd", 1)


def pack(values: np.ndarray) -> bytes:
    """Floats as they are; whole numbers less their least one, or as steps if they ascend, in as few bytes as the largest takes, all lowest bytes first."""
    n, width, up, low = len(values), 0, False, 0
    if not n:
        return b""
    if values.dtype.kind == "f":
        raw = values.astype(np.float64).tobytes()
    else:
        v = np.ascontiguousarray(values, np.int64)
        up = bool((v[1:] >= v[:-1]).all())
        low = int(v[0] if up else v.min())
        v = (np.diff(v, prepend=v[0]) if up else v - low).view(np.uint64)  # modulo 2**64
        width = max(1, (int(v.max()).bit_length() + 7) // 8)
        raw = v.view(np.uint8).reshape(n, 8)[:, :width].T.tobytes()
    return _HEAD.pack(width, up, n, low) + _CODEC.compress(raw, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    """What was packed, as int64 or float64."""
    if not data:
        return np.empty(0, np.int64)
    width, up, n, low = _HEAD.unpack_from(data)
    raw = _CODEC.decompress(data[_HEAD.size :], n * (width or 8), asbytes=True)
    if not width:
        return np.frombuffer(raw, np.float64)
    v = np.zeros((n, 8), np.uint8)
    v[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    v = v.view(np.int64).ravel()
    return (np.cumsum(v) if up else v) + np.int64(low)


def pack_words(words: list[bytes]) -> bytes:
    """Words without blanks."""
    raw = b" ".join(words)
    return struct.pack("<q", len(raw)) + _CODEC.compress(raw, asbytes=True)


def unpack_words(data: bytes) -> list[bytes]:
    return _CODEC.decompress(data[8:], struct.unpack_from("<q", data)[0], asbytes=True).split(b" ")
