"""Audio and image payloads as bytes: WAV chunks and BMP patches."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np

RATE = 8000


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """(mono samples in -1..1, rate); channels are mixed down."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, ch, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 3:  # 24 bits, widened below by a byte of zeros
        raw, width = np.insert(np.frombuffer(raw, np.uint8).reshape(-1, 3), 0, 0, 1).tobytes(), 4
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128 if width == 1 else np.frombuffer(raw, f"<i{width}").astype(float) / (1 << (8 * width - 1))
    return x.reshape(-1, ch).mean(1), rate


def write_wav(samples: np.ndarray, rate: int = RATE, width: int = 1) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(width), w.setframerate(rate)
        w.writeframes((np.clip(np.round(samples * 128) + 128, 0, 255).astype(np.uint8) if width == 1 else np.clip(samples * 32768, -32768, 32767).astype("<i2")).tobytes())
    return out.getvalue()


def chunk_wav(data: bytes, chunk_ms: int) -> list[bytes]:
    """Windows of chunk_ms at 8 kHz, mono, unsigned bytes, each a whole WAV; no window is an error."""
    x, rate = read_wav(data)
    n = int(len(x) * RATE / rate)
    y = np.interp(np.arange(n) * rate / RATE, np.arange(len(x)), x) if n and rate != RATE else x[:n]
    step = RATE * chunk_ms // 1000
    if not n or step <= 0:
        raise ValueError("no chunk")
    return [write_wav(y[i : i + step]) for i in range(0, n, step)]


def write_bmp(pixels: np.ndarray) -> bytes:
    """A 24-bit bitmap of height x width x 3."""
    h, w, _ = pixels.shape
    row = -(-w * 3 // 4) * 4
    body = np.zeros((h, row), np.uint8)
    body[:, : w * 3] = pixels[::-1, :, ::-1].reshape(h, -1)
    return struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + h * row, 0, 0, 54, 40, w, h, 1, 24, 0, h * row, 0, 0, 0, 0) + body.tobytes()


def read_bmp(data: bytes) -> np.ndarray:
    at, w, h = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26])
    row = -(-w * 3 // 4) * 4
    x = np.frombuffer(data, np.uint8, row * abs(h), at).reshape(abs(h), row)[:, : w * 3].reshape(abs(h), w, 3)[:, :, ::-1]
    return x[::-1] if h > 0 else x


def patches(data: bytes, size: int = 32) -> list[dict]:
    """Row-major square patches, zero-padded at the right and bottom, each its own bitmap."""
    x = read_bmp(data)
    h, w, _ = x.shape
    p = np.pad(x, ((0, -h % size), (0, -w % size), (0, 0)))
    at = [(i, j) for i in range(0, p.shape[0], size) for j in range(0, p.shape[1], size)]
    return [{"index": k, "x": j, "y": i, "width": w, "height": h, "data": write_bmp(p[i : i + size, j : j + size])} for k, (i, j) in enumerate(at)]


def reassemble(parts: list[dict]) -> bytes:
    parts = sorted(parts, key=lambda r: r["index"])
    w, h = parts[0]["width"], parts[0]["height"]
    blocks = [(r["y"], r["x"], read_bmp(r["data"])) for r in parts]
    out = np.zeros((max(y + b.shape[0] for y, _, b in blocks), max(x + b.shape[1] for _, x, b in blocks), 3), np.uint8)
    for y, x, b in blocks:
        out[y : y + b.shape[0], x : x + b.shape[1]] = b
    return write_bmp(out[:h, :w])
