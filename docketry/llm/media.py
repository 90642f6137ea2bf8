"""Media columns: bytes kept in progressive JPEG images, and full-resolution RGB tensors from such images.

A payload is stored in the format's own unit, the quantised coefficient: with all quantisers one, a
coefficient is an integer that the file keeps exactly. Each byte is the eight value bits of a coefficient of
size category eight (-255..-128 and 128..255), 63 to a block, in a 4:2:0 image of three components. The
file has the scans of a progressive image: direct-current terms with a refinement, two spectral bands
without their lowest bit, and a refinement of all of them.

Reading accumulates the scans into coefficient arrays, which give the payload back; numpy transforms them,
chroma is upsampled and the result is an RGB tensor of full resolution. Scans whose Huffman table has one code of
one bit are of fixed width and are read as whole arrays; others are read code by code.

Defined cases: an image that is null, broken or not progressive gives null results and the reason in `error`; a null or empty text is a payload of 64 zero bytes; equal texts give equal bytes; texts may be as
long as one value of a column; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices

UNIT = 64  # payloads are padded with zero bytes to a positive multiple of this
AC = 63  # coefficients of a block that hold payload
LUMA_BLOCKS = 4  # of a 16 x 16 unit, beside one block of each chroma component
#: (first, last) coefficient of the spectral bands in zigzag order.
BANDS = [(1, 5), (6, 63)]


@cache
def zigzag() -> np.ndarray:
    """Natural place of each coefficient in zigzag order: diagonals, walked up and down in turn."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[1] if (x[0] + x[1]) % 2 == 0 else x[0]))
    return np.array([8 * r + c for r, c in cells])


# --- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _lone_code(kind: int, place: int, symbol: int) -> bytes:
    """A Huffman table whose only symbol has the code 0."""
    return _segment(0xC4, bytes([kind << 4 | place, 1, *[0] * 15, symbol]))


def _scan(components: list[int], tables: int, first: int, last: int, high: int, low: int, bits: bytes) -> bytes:
    head = bytes([len(components), *[x for c in components for x in (c, tables)], first, last, high << 4 | low])
    return _segment(0xDA, head) + bits.replace(b"\xff", b"\xff\x00")


def _zero_bits(n: int) -> bytes:
    """n zero bits, filled up with ones."""
    return bytes(n // 8) + (bytes([0xFF >> n % 8]) if n % 8 else b"")


def write_jpeg(payload: bytes) -> bytes:
    """A progressive 4:2:0 image whose coefficients are the payload's bytes, zeros after them."""
    units = max(1, -(-len(payload) // (AC * (LUMA_BLOCKS + 2))))
    across = math.isqrt(units - 1) + 1
    down = -(-units // across)
    n = across * down
    blocks = np.zeros((n * (LUMA_BLOCKS + 2), AC), "u1")
    blocks.reshape(-1)[: len(payload)] = np.frombuffer(payload, "u1")
    parts = np.split(blocks, [LUMA_BLOCKS * n, (LUMA_BLOCKS + 1) * n])
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDB, bytes([0, *[1] * 64])),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _lone_code(0, 0, 0),  # a difference of zero
        _lone_code(1, 0, 7),  # no zeros before a value of seven bits
        _lone_code(1, 1, 0),  # the block ends, after its correction bits
        _scan([1, 2, 3], 0, 0, 0, 0, 1, _zero_bits(len(blocks))),
        _scan([1, 2, 3], 0, 0, 0, 1, 0, _zero_bits(len(blocks))),
    ]
    for c, own in enumerate(parts, 1):
        for first, last in BANDS:  # the code 0 and seven bits are one byte
            out.append(_scan([c], 0, first, last, 0, 1, (own[:, first - 1 : last] >> 1).tobytes()))
        low = np.where(own >= 128, own & 1, 1 - (own & 1))  # lowest bit of the magnitude
        refine = np.concatenate([np.zeros((len(own), 1), "u1"), low], axis=1)
        out.append(_scan([c], 1, 1, 63, 1, 0, np.packbits(refine).tobytes()))
    return b"".join([*out, b"\xff\xd9"])


# --- reading


class Component:
    """One component's sampling, quantiser and coefficients (blocks in rows, zigzag order)."""

    def __init__(self, across: int, down: int, table: int):
        self.across, self.down, self.table = across, down, table

    def allot(self, width: int, height: int, most_across: int, most_down: int) -> None:
        units = -(-width // (8 * most_across)), -(-height // (8 * most_down))
        self.stride, self.rows = units[0] * self.across, units[1] * self.down
        self.used = (-(-(-(-width * self.across // most_across)) // 8), -(-(-(-height * self.down // most_down)) // 8))
        self.units = units
        self.coefficients = np.zeros((self.stride * self.rows, 64), "int32")

    def own_blocks(self) -> np.ndarray:
        """Blocks of a scan of this component alone."""
        return (np.arange(self.used[1])[:, None] * self.stride + np.arange(self.used[0])).reshape(-1)

    def unit_blocks(self) -> np.ndarray:
        """Blocks by unit of a scan of several components."""
        x, y = self.units
        rows = np.arange(y)[:, None, None, None] * self.down + np.arange(self.down)[:, None]
        columns = np.arange(x)[:, None, None] * self.across + np.arange(self.across)
        return (rows * self.stride + columns).reshape(x * y, -1)


class Bits:
    """Bits of one scan, read one after another."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, "u1")).tolist(), 0

    def take(self, n: int) -> int:
        value = 0
        for bit in self.bits[self.at : self.at + n]:
            value = value << 1 | bit
        self.at += n
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such Huffman code")

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, codes counting up within a length and doubled for the next."""
    out, code, k = {}, 0, 0
    for length, many in enumerate(lengths, 1):
        for _ in range(many):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lone(codes: dict[tuple[int, int], int]) -> int | None:
    return codes[1, 0] if set(codes) == {(1, 0)} else None


def _dc_scan(parts: list[tuple[Component, dict]], data: bytes, refine: bool, low: int) -> None:
    order = [(c, codes, blocks) for (c, codes), blocks in zip(parts, [p.unit_blocks() if len(parts) > 1 else p.own_blocks()[:, None] for p, _ in parts])]
    if refine:
        width = sum(blocks.shape[1] for *_, blocks in order)
        bits = np.unpackbits(np.frombuffer(data, "u1"), count=len(order[0][2]) * width).reshape(-1, width)
        for c, _, blocks in order:
            c.coefficients[blocks, 0] |= bits[:, : blocks.shape[1]].astype("int32") << low
            bits = bits[:, blocks.shape[1] :]
    elif any(_lone(codes) != 0 for _, codes, _ in order):
        bits, before = Bits(data), [0] * len(order)
        for unit in range(len(order[0][2])):
            for k, (c, codes, blocks) in enumerate(order):
                for block in blocks[unit]:
                    before[k] += bits.signed(bits.symbol(codes))
                    c.coefficients[block, 0] = before[k] << low


def _ac_first(c: Component, codes: dict, data: bytes, first: int, last: int, low: int) -> None:
    blocks, band, lone = c.own_blocks(), last - first + 1, _lone(codes)
    if lone and lone < 16:  # no zeros, one size: fixed width
        raw = np.frombuffer(data, "u1")
        if lone == 7:
            value = raw[: len(blocks) * band].astype("int32")
        else:
            bits = np.unpackbits(raw, count=len(blocks) * band * (lone + 1)).reshape(-1, lone + 1)[:, 1:]
            value = bits.astype("int32") @ (1 << np.arange(lone - 1, -1, -1))
        value = np.where(value >> (lone - 1), value << low, -(((1 << lone) - 1 - value) << low))
        c.coefficients[blocks, first : last + 1] = value.reshape(len(blocks), band)
        return
    bits, ended = Bits(data), 0
    for block in blocks:
        k = first
        while k <= last and not ended:
            zeros, size = divmod(bits.symbol(codes), 16)
            if size:
                k += zeros
                value = bits.signed(size)
                c.coefficients[block, k] = value << low if value > 0 else -(-value << low)
                k += 1
            elif zeros == 15:
                k += 16
            else:
                ended = (1 << zeros) + bits.take(zeros)
        ended = max(0, ended - 1)


def _ac_refine(c: Component, codes: dict, data: bytes, first: int, last: int, low: int) -> None:
    blocks, band = c.own_blocks(), last - first + 1
    held = c.coefficients[blocks, first : last + 1]
    if _lone(codes) == 0 and (held != 0).all():  # each block: it ends at once, and a bit for each coefficient
        bits = np.unpackbits(np.frombuffer(data, "u1"), count=len(blocks) * (band + 1)).reshape(-1, band + 1)[:, 1:].astype("int32") << low
        c.coefficients[blocks, first : last + 1] = held + np.where(held > 0, bits, -bits)
        return
    bits, ended = Bits(data), 0

    def correct(row: np.ndarray, k: int) -> None:
        if bits.take(1):
            row[k] += (1 if row[k] > 0 else -1) << low

    for block in blocks:
        row, k = c.coefficients[block], first
        while k <= last and not ended:
            zeros, size = divmod(bits.symbol(codes), 16)
            if not size and zeros < 15:
                ended = (1 << zeros) + bits.take(zeros)
                break
            value = (1 if bits.take(1) else -1) << low if size else 0
            while k <= last:
                if row[k]:
                    correct(row, k)
                elif zeros:
                    zeros -= 1
                else:
                    break
                k += 1
            if size and k <= last:
                row[k] = value
            k += 1
        if ended:
            for at in range(k, last + 1):
                if row[at]:
                    correct(row, at)
            ended -= 1


def _entropy_end(data: bytes, at: int) -> int:
    """Where the scan's data end: the next marker that is no stuffed byte."""
    while True:
        at = data.index(b"\xff", at)
        if data[at + 1]:
            return at
        at += 2


#: Most pixels a byte of a file: a block of 64 takes a few bits at least.
MOST_PIXELS_A_BYTE = 4096


def read_jpeg(data: bytes) -> tuple[int, int, list[Component], dict[int, np.ndarray], bytes]:
    """(width, height, components, quantisers in zigzag order, comment) of a progressive image without restarts."""
    at, quantisers, codes, comment = 2, {}, {}, b""
    components: dict[int, Component] = {}
    width = height = 0
    while (marker := data[at + 1]) != 0xD9:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype("int64")
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                many = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15] = _codes(body[1:17], body[17 : 17 + many])
                body = body[17 + many :]
        elif marker == 0xC2:
            height, width = struct.unpack(">HH", body[1:5])
            if components or not width or not height or not 1 <= body[5] <= 4 or width * height > len(data) * MOST_PIXELS_A_BYTE:
                raise ValueError("no frame of this size")
            for k in range(body[5]):
                name, sampling, table = body[6 + 3 * k : 9 + 3 * k]
                if not 1 <= sampling >> 4 <= 4 or not 1 <= sampling & 15 <= 4:
                    raise ValueError("no such sampling")
                components[name] = Component(sampling >> 4, sampling & 15, table)
            most = max(c.across for c in components.values()), max(c.down for c in components.values())
            for c in components.values():
                c.allot(width, height, *most)
        elif marker == 0xFE:
            comment = body
        elif marker == 0xDA:
            end = _entropy_end(data, at)
            bits, at = data[at:end].replace(b"\xff\x00", b"\xff"), end
            chosen = [(components[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(body[0])]
            first, last, shift = body[-3:]
            high, low = shift >> 4, shift & 15
            if not chosen or last > 63 or first > last or low > 13:
                raise ValueError("no scan of this kind")
            if first == 0:
                _dc_scan([(c, codes.get((0, t >> 4), {})) for c, t in chosen], bits, high > 0, low)
            else:
                (_ac_refine if high else _ac_first)(chosen[0][0], codes[1, chosen[0][1] & 15], bits, first, last, low)
        elif marker == 0xDD or marker in (0xC0, 0xC1):
            raise ValueError("only progressive images without restart intervals are read")
    return width, height, list(components.values()), quantisers, comment


def payload_of(components: list[Component], comment: bytes) -> bytes:
    """The bytes that write_jpeg stored."""
    values = np.concatenate([c.coefficients[:, 1:].reshape(-1) for c in components])
    return np.where(values < 0, values + 255, values).astype("u1").tobytes()[: int(comment.split()[1])]


SCALE = 1 << 13


@cache
def _basis() -> np.ndarray:
    """Pixels of a block from its coefficients in zigzag order; whole numbers, so sums are exact and the same everywhere."""
    k = np.arange(8)
    waves = np.cos((2 * k[:, None] + 1) * k * np.pi / 16) * np.where(k == 0, math.sqrt(0.5), 1) / 2  # pixel, frequency
    both = np.einsum("yv,xu->vuyx", waves, waves).reshape(64, 64)
    return np.round(both[zigzag()] * SCALE)


def plane(c: Component, quantiser: np.ndarray) -> np.ndarray:
    """Samples of one component over its allotted blocks."""
    pixels = np.floor(((c.coefficients * quantiser) @ _basis() + SCALE // 2) / SCALE) + 128
    blocks = np.clip(pixels, 0, 255).astype("int32").reshape(c.rows, c.stride, 8, 8)
    return blocks.transpose(0, 2, 1, 3).reshape(8 * c.rows, 8 * c.stride)


def rgb_tensor(width: int, height: int, components: list[Component], quantisers: dict[int, np.ndarray]) -> np.ndarray:
    """Height x width x 3 unsigned bytes; chroma is repeated to full resolution."""
    across, down = max(c.across for c in components), max(c.down for c in components)
    planes = []
    for c in components:
        own = plane(c, quantisers[c.table])
        planes.append(own.repeat(down // c.down, axis=0).repeat(across // c.across, axis=1)[:height, :width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2).astype("u1")
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    half = 1 << 15  # factors of the usual conversion, in 65536ths
    red, green, blue = y + (91881 * cr + half >> 16), y - (22554 * cb + 46802 * cr + half >> 16), y + (116130 * cb + half >> 16)
    return np.stack([np.clip(x, 0, 255).astype("u1") for x in (red, green, blue)], axis=2)


def feature(tensor: np.ndarray) -> str:
    """Size, and the sum and sum of squares of each channel."""
    flat = tensor.reshape(-1, 3).astype("int64")
    return "%dx%d;" % (tensor.shape[1], tensor.shape[0]) + ";".join(",".join(map(str, x)) for x in (flat.sum(0).tolist(), (flat * flat).sum(0).tolist()))


# --- columns


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the image that holds the padded text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            images = [write_jpeg(t + bytes(max(UNIT, -(-len(t) // UNIT) * UNIT) - len(t))) for t in texts]
            yield pa.record_batch([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def load(df: DataFrame, tensors: bool = True) -> DataFrame:
    """Adds payload, feature, error (null where the image was read), and with tensors also width, height and rgb (height x width x 3 bytes), from the column media.

    Other columns of these names are replaced. An image that can't be read, or is too large for what it holds, gives nulls and a reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_media"):
            payloads, features, errors, images = [], [], [], []
            for media in batch.column("_media").to_pylist():
                payload = found = width = height = tensor = error = None
                try:
                    width, height, components, quantisers, comment = read_jpeg(media or b"")
                    tensor = rgb_tensor(width, height, components, quantisers)
                    payload, found = payload_of(components, comment) if comment.startswith(b"payload ") else None, feature(tensor)
                except (ArithmeticError, LookupError, TypeError, ValueError, struct.error) as e:
                    payload = width = height = tensor = None
                    error = "no image" if not media else str(e) or type(e).__name__
                for column, value in ((payloads, payload), (features, found), (errors, error)):
                    column.append(value)
                if tensors:
                    images.append((width, height, None if tensor is None else tensor.tobytes()))
            columns = [batch.column("_row"), pa.array(payloads, pa.binary()), pa.array(features, pa.string()), pa.array(errors, pa.string())]
            if tensors:
                columns += [pa.array([x[0] for x in images], pa.int32()), pa.array([x[1] for x in images], pa.int32()), pa.array([x[2] for x in images], pa.binary())]
            yield pa.record_batch(columns, ["_row", *added])

    added = ["payload", "feature", "error", *["width", "height", "rgb"] * tensors]
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col("media").alias("_media"))
    schema = T.StructType([rows.schema["_row"]]).add("payload", "binary").add("feature", "string").add("error", "string")
    if tensors:
        schema = schema.add("width", "integer").add("height", "integer").add("rgb", "binary")
    out = in_batches(rows).mapInArrow(run, schema)
    return out.select(*[F.col("_row")[c].alias(c) for c in df.columns if c not in added], *added)
