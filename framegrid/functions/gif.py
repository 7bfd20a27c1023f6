"""Palettes and the GIF format: median cut, nearest entries, LZW, and whole files of frames with one transparent entry."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

#: Entries of a palette besides the last one, which is transparent.
COLOURS, CLEAR = 255, 255


def median_cut(colours: np.ndarray, weights: np.ndarray, size: int = COLOURS) -> np.ndarray:
    """At most ``size`` colours for the weighted ones: the heaviest, widest box is cut at its weighted median until there are enough; a box gives its mean."""
    boxes = [np.arange(len(colours))] if len(colours) else []
    spread = lambda b: np.ptp(colours[b], axis=0)
    rank = [float(weights[b].sum()) * int(spread(b).max()) for b in boxes]
    while len(boxes) < size and rank and max(rank) > 0:
        k = int(np.argmax(rank))
        box = boxes.pop(k)
        rank.pop(k)
        box = box[np.argsort(colours[box, int(spread(box).argmax())], kind="stable")]
        line = colours[box, int(spread(box).argmax())]
        upto = np.cumsum(weights[box])
        cut = int(np.searchsorted(upto, upto[-1] / 2)) + 1
        cut = min(max(cut, int(np.searchsorted(line, line[0], "right"))), int(np.searchsorted(line, line[-1], "left")))  # both parts hold a colour of their own
        for part in (box[:cut], box[cut:]):
            boxes.append(part)
            rank.append(float(weights[part].sum()) * int(spread(part).max()))
    means = [np.rint((colours[b] * weights[b][:, None]).sum(axis=0) / weights[b].sum()) for b in boxes]
    return np.unique(np.array(means, np.uint8).reshape(-1, 3), axis=0)


def nearest(rgb: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """For every pixel the number of the palette's nearest colour, the first of equals."""
    packed = rgb.reshape(-1, 3).astype(np.int64) @ (65536, 256, 1)
    own, at = np.unique(packed, return_inverse=True)
    colours = np.stack((own >> 16, own >> 8 & 255, own & 255), axis=1)
    out = np.empty(len(own), np.uint8)
    for k in range(0, len(own), 4096):
        out[k : k + 4096] = ((colours[k : k + 4096, None] - palette[None].astype(np.int64)) ** 2).sum(axis=2).argmin(axis=1)
    return out[at].reshape(rgb.shape[:2])


def lzw(data: bytes, bits: int = 8) -> bytes:
    """Variable-length codes of up to twelve bits, lowest bit first; the table starts anew when it is full."""
    clear, end = 1 << bits, (1 << bits) + 1
    table, size, held, n, out = {}, bits + 1, clear, bits + 1, bytearray()
    code, free = -1, end + 1
    for b in data:
        if code < 0:
            code = b
            continue
        known = table.get(code << 8 | b)
        if known is not None:
            code = known
            continue
        held |= code << n
        n += size
        if free < 4096:
            table[code << 8 | b] = free
            if free == 1 << size:
                size += 1
            free += 1
        else:
            held |= clear << n
            n += size
            table, size, free = {}, bits + 1, end + 1
        if n >= 512:
            out += (held & (1 << n // 8 * 8) - 1).to_bytes(n // 8, "little")
            held, n = held >> n // 8 * 8, n % 8
        code = b
    if code >= 0:
        held |= code << n
        n += size
        if free == 1 << size and size < 12:
            size += 1
    held |= end << n
    n += size
    return bytes(out + held.to_bytes(-(-n // 8), "little"))


def unlzw(data: bytes, bits: int) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    table = [bytes([k]) for k in range(clear)] + [b"", b""]
    size, held, n, last, out = bits + 1, 0, 0, None, []
    for byte in data:
        held |= byte << n
        n += 8
        while n >= size:
            code, held, n = held & (1 << size) - 1, held >> size, n - size
            if code == clear:
                del table[end + 1 :]
                size, last = bits + 1, None
            elif code == end:
                return b"".join(out)
            else:
                if last is None:
                    word = table[code]
                elif code < len(table):
                    word = table[code]
                    if len(table) < 4096:
                        table.append(last + word[:1])
                elif code == len(table):
                    word = last + last[:1]
                    table.append(word)
                else:
                    raise ValueError("a code beyond the table")
                out.append(word)
                last = word
                if len(table) == 1 << size and size < 12:
                    size += 1
    raise ValueError("the data end without an end code")


def head(w: int, h: int, palette: np.ndarray) -> bytes:
    """What comes before the frames: sizes, the palette, and that the clip loops for ever."""
    colours = np.zeros((256, 3), np.uint8)
    colours[: len(palette)] = palette
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, CLEAR, 0) + colours.tobytes() + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"


def frame(index: np.ndarray, delay: int) -> bytes:
    """A frame of palette numbers that is cleared after ``delay`` hundredths of a second."""
    h, w = index.shape
    data = lzw(index.tobytes())
    blocks = b"".join(bytes([len(data[k : k + 255])]) + data[k : k + 255] for k in range(0, len(data), 255))
    return b"\x21\xf9\x04\x09" + struct.pack("<HBB", delay, CLEAR, 0) + b"\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b"\0"


TAIL = b"\x3b"


def decode(data: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """All frames of ``decoded``."""
    return list(decoded(data))


def decoded(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rgb, alpha) of one frame after the other of a file as ``head``, ``frame`` and TAIL write it: whole frames by one palette; transparent pixels are black."""
    if data[:6] != b"GIF89a" or len(data) < 13 or not data[10] & 0x80:
        raise ValueError("no GIF with a palette of its own")
    n = 2 << (data[10] & 7)
    palette = np.frombuffer(data, np.uint8, 3 * n, 13).reshape(n, 3)
    at, gone = 13 + 3 * n, None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    try:
        while data[at] != TAIL[0]:
            if data[at] == 0x21:
                body, end = blocks(at + 2)
                if data[at + 1] == 0xF9:
                    gone = body[3] if body[0] & 1 else None
                at = end
            elif data[at] == 0x2C:
                _, _, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
                if flags & 0xC0:
                    raise ValueError("frames with a palette of their own, or interlaced, aren't read")
                body, end = blocks(at + 11)
                index = np.frombuffer(unlzw(body, data[at + 10]), np.uint8).reshape(h, w)
                alpha = np.where(index == gone, 0, 255).astype(np.uint8) if gone is not None else np.full((h, w), 255, np.uint8)
                yield np.where(alpha[..., None] > 0, palette[index], 0).astype(np.uint8), alpha
                at = end
            else:
                raise ValueError(f"an unknown block at {at}")
    except IndexError:
        raise ValueError("the file ends within a frame") from None
