"""Writing PNG files: gray or colour, eight bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(data: bytes, height: int, width: int, channels: int = 1) -> bytes:
    """A PNG of BGR or gray bytes by rows."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels[..., ::-1].reshape(height, -1)], axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if channels == 1 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")
