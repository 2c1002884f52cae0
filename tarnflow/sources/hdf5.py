"""NetCDF-4 cubes: arrays in HDF5 files, read chunk by chunk.

Only what a cube needs of the format (HDF5 File Format Specification 3.0, public): links and
attributes, also densely stored ones; contiguous, compact and chunked arrays of numbers; the chunk
index; shuffle, deflate, Fletcher-32.  A read walks the index to the chunks that hold the steps and
cells asked for, and reads and decodes these alone.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
# Message types of object headers, and filters.
_SPACE, _LINK_INFO, _TYPE, _FILL, _LINK, _LAYOUT, _FILTERS, _ATTRIBUTE, _CONTINUED, _SYMBOLS, _ATTRIBUTE_INFO = 0x01, 0x02, 0x03, 0x05, 0x06, 0x08, 0x0B, 0x0C, 0x10, 0x11, 0x15
_DEFLATE, _SHUFFLE, _FLETCHER = 1, 2, 3


@dataclass
class Array:
    shape: tuple[int, ...] = ()
    kind: np.dtype | None = None
    fill: bytes = b""
    filters: list[tuple[int, tuple[int, ...]]] = field(default_factory=list)
    chunk: tuple[int, ...] | None = None  # of chunked arrays
    index: tuple | None = None  # ("tree", address), ("single", address, size, mask), ("implicit", address), ("fixed", address)
    at: int | None = None  # of contiguous arrays
    data: bytes | None = None  # of compact arrays
    attributes: dict = field(default_factory=dict)


class _Bytes:
    """Little-endian fields, one after the other."""

    def __init__(self, raw: bytes, wide: int, long: int, at: int = 0):
        self.raw, self.wide, self.long, self.at = raw, wide, long, at

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.raw):
            raise ValueError("the file ends within a structure")
        return self.raw[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "little")

    def address(self) -> int | None:
        raw = self.take(self.wide)
        return None if raw == b"\xff" * self.wide else int.from_bytes(raw, "little")

    def length(self) -> int:
        return self.number(self.long)


class Hdf5:
    """Variables of the root group, as `netcdf.Classic` gives them."""

    def __init__(self, f):
        self.f = f
        head = self._raw(0, 128, short=True)
        if head[:8] != SIGNATURE:
            raise ValueError("not an HDF5 file")
        version = head[8]
        if version in (0, 1):
            self.wide, self.long = head[13], head[14]
            b = self._over(head, 24 + 4 * version)
            self.base = b.address() or 0
            b.take(3 * self.wide)  # free space, end of file, driver
            b.take(self.wide)  # name of the root
            root = b.address()
        elif version in (2, 3):
            self.wide, self.long = head[9], head[10]
            b = self._over(head, 12)
            self.base = b.address() or 0
            b.take(2 * self.wide)  # extension, end of file
            root = b.address()
        else:
            raise ValueError(f"HDF5 superblock version {version} is unknown")
        self.links = self._links(root)
        self.names_at = {at: n for n, at in self.links.items()}
        self._made: dict[str, Array] = {}

    # What readers ask for.

    def __contains__(self, name: str) -> bool:
        return name in self.links

    def array(self, name: str) -> Array:
        if name not in self._made:
            if name not in self.links:
                raise KeyError(f"no variable {name}")
            self._made[name] = self._array(self.links[name])
        return self._made[name]

    def shape(self, name: str) -> list[int]:
        return list(self.array(name).shape)

    def attributes(self, name: str) -> dict:
        return self.array(name).attributes

    def dims(self, name: str) -> list[str]:
        """Names of the dimensions, by the references to their scales."""
        a = self.array(name)
        if a.attributes.get("CLASS") == "DIMENSION_SCALE" and len(a.shape) == 1:
            return [name]
        found = a.attributes.get("DIMENSION_LIST")
        if not isinstance(found, list) or len(found) != len(a.shape):
            raise ValueError(f"{name} does not refer to its dimensions")
        return [self.names_at[at] for at in found]

    def steps_together(self, name: str) -> int:
        """Steps that share a chunk."""
        a = self.array(name)
        return a.chunk[0] if a.chunk else 1

    def read(self, name: str, first: int = 0, count: int | None = None) -> np.ndarray:
        a = self.array(name)
        if not a.shape:
            return self._stored(a)[0]
        count = a.shape[0] - first if count is None else min(count, a.shape[0] - first)
        cells = int(np.prod(a.shape[1:], dtype=np.int64))
        return self.cells(name, first, count, np.arange(cells)).reshape([count, *a.shape[1:]])

    def cells(self, name: str, first: int, count: int, flat: np.ndarray) -> np.ndarray:
        """[steps, cells] of the cells with these places (ascending) within a step."""
        a = self.array(name)
        each = int(np.prod(a.shape[1:], dtype=np.int64))
        if a.chunk is None:
            if a.at is None:  # compact, or never written
                return self._stored(a).reshape(-1, each)[first : first + count][:, flat]
            return ranges(lambda at, n: self._raw(at, n), a.at + first * each * a.kind.itemsize, each * a.kind.itemsize, count, flat, a.kind)
        out = np.full((count, len(flat)), np.frombuffer(a.fill, a.kind)[0] if a.fill else 0, a.kind)
        place = np.array(np.unravel_index(flat, a.shape[1:]), np.int64) if len(a.shape) > 1 else np.zeros((0, len(flat)), np.int64)
        grid = [-(-n // c) for n, c in zip(a.shape, a.chunk)]
        size = np.array(a.chunk[1:], np.int64)[:, None]
        home = place // size
        number = np.ravel_multi_index(tuple(home), grid[1:]) if len(grid) > 1 else np.zeros(len(flat), np.int64)
        order = np.argsort(number, kind="stable")
        wanted, begin = np.unique(number[order], return_index=True)
        members = dict(zip(wanted.tolist(), np.split(order, begin[1:])))
        for offset, at, stored, mask in self._chunks(a, first, first + count):
            own = members.get(int(np.ravel_multi_index([o // c for o, c in zip(offset[1:], a.chunk[1:])], grid[1:])) if len(grid) > 1 else 0)
            if own is None:
                continue
            chunk = np.frombuffer(self._decoded(a, self._raw(at, stored), mask), a.kind).reshape(a.chunk)
            low, high = max(first, offset[0]), min(first + count, offset[0] + a.chunk[0], a.shape[0])
            inside = (place - home * size)[:, own]
            out[low - first : high - first, own] = chunk[(slice(low - offset[0], high - offset[0]), *inside)].reshape(high - low, -1)
        return out

    # Chunks.

    def _chunks(self, a: Array, first: int, past: int):
        """offset, address, stored bytes and filter mask of the chunks with steps from first to past."""
        whole = int(np.prod(a.chunk)) * a.kind.itemsize
        kind, at, *more = a.index
        if at is None:
            return
        if kind == "tree":
            yield from self._tree(a, at, first, past)
        elif kind == "single":
            yield (0,) * len(a.chunk), at, more[0] or whole, more[1]
        else:
            grid = [-(-n // c) for n, c in zip(a.shape, a.chunk)]
            across = int(np.prod(grid[1:], dtype=np.int64))
            numbers = range(first // a.chunk[0] * across, -(-past // a.chunk[0]) * across)
            found = self._fixed(a, at) if kind == "fixed" else None
            for n in numbers:
                where, stored, mask = found[n] if found else (at + n * whole, whole, 0)
                if where is not None:
                    yield tuple(int(i) * c for i, c in zip(np.unravel_index(n, grid), a.chunk)), where, stored or whole, mask

    def _tree(self, a: Array, at: int, first: int, past: int):
        """Leaves below a node of the chunk index whose steps may be asked for; others are not read."""
        rank = len(a.shape)
        head = self._raw(at, 8 + 2 * self.wide)
        if head[:4] != b"TREE" or head[4] != 1:
            raise ValueError("not a chunk index")
        level, used = head[5], int.from_bytes(head[6:8], "little")
        width = 8 + 8 * (rank + 1)
        b = self._over(self._raw(at + 8 + 2 * self.wide, used * (width + self.wide) + width), 0)
        entries = []
        for _ in range(used):
            stored, mask = b.number(4), b.number(4)
            offset = struct.unpack(f"<{rank + 1}Q", b.take(8 * (rank + 1)))[:rank]
            entries.append((offset, stored, mask, b.address()))
        after = struct.unpack("<Q", b.raw[b.at + 8 : b.at + 16])[0]
        ends = [e[0][0] for e in entries[1:]] + [after]
        for (offset, stored, mask, child), end in zip(entries, ends):
            if level == 0:
                if offset[0] < past and offset[0] + a.chunk[0] > first:
                    yield offset, child, stored, mask
            elif offset[0] < past and end + a.chunk[0] > first:  # keys ascend by step
                yield from self._tree(a, child, first, past)

    def _fixed(self, a: Array, at: int) -> list[tuple[int | None, int, int]]:
        """Address, stored bytes and mask of every chunk of an array with an index of fixed size."""
        b = self._over(self._raw(at, 8 + self.long + self.wide + 4), 4)
        _, client, width, page_bits = b.number(1), b.number(1), b.number(1), b.number(1)
        count, block = b.length(), b.address()
        if block is None:
            return [(None, 0, 0)] * count
        if count > 1 << page_bits:
            raise ValueError("paged chunk indexes are not read; rewrite the file with the default format version")
        b = self._over(self._raw(block + 6 + self.wide, count * width), 0)
        read = (lambda: (b.address(), b.number(width - self.wide - 4), b.number(4))) if client else (lambda: (b.address(), 0, 0))
        return [read() for _ in range(count)]

    def _decoded(self, a: Array, raw: bytes, mask: int) -> bytes:
        for n, (which, values) in reversed(list(enumerate(a.filters))):
            if mask >> n & 1:
                continue
            if which == _FLETCHER:
                raw = raw[:-4]
            elif which == _DEFLATE:
                raw = zlib.decompress(raw)
            elif which == _SHUFFLE:
                size = values[0] if values else a.kind.itemsize
                whole = len(raw) // size * size
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(size, -1).T.tobytes() + raw[whole:]
            else:
                raise ValueError(f"filter {which} is not supported")
        return raw

    def _stored(self, a: Array) -> np.ndarray:
        n = int(np.prod(a.shape, dtype=np.int64))
        if a.data is not None:
            return np.frombuffer(a.data, a.kind, count=n)
        if a.at is not None:
            return np.frombuffer(self._raw(a.at, n * a.kind.itemsize), a.kind)
        return np.full(n, np.frombuffer(a.fill, a.kind)[0] if a.fill else 0, a.kind)

    # Structures.

    def _raw(self, at: int, n: int, short: bool = False) -> bytes:
        self.f.seek(at + (0 if short else self.base))
        raw = self.f.read(n)
        if len(raw) < n and not short:
            raise ValueError("the file ends within a structure")
        return raw

    def _over(self, raw: bytes, at: int) -> _Bytes:
        return _Bytes(raw, self.wide, self.long, at)

    def _messages(self, at: int) -> list[tuple[int, bytes]]:
        """Type and content of an object header's messages, of both versions."""
        out, blocks = [], []
        head = self._raw(at, 16)
        if head[:4] == b"OHDR":
            flags = head[5]
            skip = 6 + (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(self._raw(at + skip, width), "little")
            blocks, new, order = [(at + skip + width, size)], True, 2 if flags & 4 else 0
        else:
            if head[0] != 1:
                raise ValueError("not an object header")
            blocks, new, order = [(at + 16, int.from_bytes(head[8:12], "little"))], False, 0
        while blocks:
            begin, size = blocks.pop(0)
            b = self._over(self._raw(begin, size), 0)
            while b.at + (4 + order if new else 8) <= size:
                if new:
                    kind, n, flags = b.number(1), b.number(2), b.number(1)
                    b.take(order)
                else:
                    kind, n, flags = b.number(2), b.number(2), b.number(1)
                    b.take(3)
                content = b.take(n)
                if kind == _CONTINUED:
                    c = self._over(content, 0)
                    to, length = c.address(), c.length()
                    blocks.append((to + 4, length - 8) if new else (to, length))  # without signature and checksum
                elif flags & 2:
                    raise ValueError("shared messages are not read")
                else:
                    out.append((kind, content))
        return out

    def _links(self, at: int) -> dict[str, int]:
        out: dict[str, int] = {}
        for kind, raw in self._messages(at):
            b = self._over(raw, 0)
            if kind == _LINK:
                out |= self._link(raw)
            elif kind == _LINK_INFO:
                b.take(1)
                b.take(8 if b.number(1) & 1 else 0)
                heap, names = b.address(), b.address()
                if heap is not None:
                    for record in self._records(names):
                        out |= self._link(self._heaped(heap, record[4:]))
            elif kind == _SYMBOLS:
                tree, heap = b.address(), b.address()
                h = self._over(self._raw(heap, 8 + 2 * self.long + self.wide), 8 + 2 * self.long)
                out |= self._symbols(tree, h.address())
        return out

    def _link(self, raw: bytes) -> dict[str, int]:
        b = self._over(raw, 1)
        flags = b.number(1)
        kind = b.number(1) if flags & 8 else 0
        b.take(8 if flags & 4 else 0)
        b.take(1 if flags & 16 else 0)
        name = b.take(b.number(1 << (flags & 3))).decode()
        return {name: b.address()} if kind == 0 else {}

    def _symbols(self, at: int, text: int) -> dict[str, int]:
        out: dict[str, int] = {}
        head = self._raw(at, 8)
        if head[:4] == b"SNOD":
            b = self._over(self._raw(at + 8, int.from_bytes(head[6:8], "little") * (2 * self.wide + 24)), 0)
            while b.at < len(b.raw):
                name, to = b.address(), b.address()
                b.take(24)
                out[self._text(text + name)] = to
            return out
        used = int.from_bytes(head[6:8], "little")
        b = self._over(self._raw(at + 8 + 2 * self.wide, used * (self.long + self.wide)), 0)
        for _ in range(used):
            b.length()
            out |= self._symbols(b.address(), text)
        return out

    def _text(self, at: int) -> str:
        self.f.seek(at + self.base)
        raw = b""
        while b"\0" not in raw:
            more = self.f.read(64)
            if not more:
                break
            raw += more
        return raw.split(b"\0")[0].decode()

    def _records(self, at: int) -> list[bytes]:
        """Records of a version 2 tree of at most two levels."""
        b = self._over(self._raw(at, 16 + self.wide + 2), 6)
        node, size, depth = b.number(4), b.number(2), b.number(2)
        b.take(2)
        root, count = b.address(), b.number(2)
        if root is None:
            return []
        most = (node - 10) // size
        width = (most.bit_length() + 7) // 8
        of = lambda raw, n: [raw[6 + k * size : 6 + (k + 1) * size] for k in range(n)]
        raw = self._raw(root, 6 + count * size + (count + 1) * (self.wide + width) * (depth > 0))
        if depth == 0:
            return of(raw, count)
        if depth > 1:
            raise ValueError("an index of more than two levels is not read")
        out, c = of(raw, count), self._over(raw, 6 + count * size)
        for _ in range(count + 1):
            to, n = c.address(), c.number(width)
            out += of(self._raw(to, 6 + n * size), n)
        return out

    def _heaped(self, at: int, ident: bytes) -> bytes:
        """An object of a fractal heap."""
        b = self._over(self._raw(at, 22 + 12 * self.long + 3 * self.wide), 5)
        b.take(2)
        filtered, flags, most = b.number(2), b.number(1), b.number(4)
        b.take(self.long + self.wide + self.long + self.wide + 8 * self.long)
        table, start, largest = b.number(2), b.length(), b.length()
        bits = b.number(2)
        b.take(2)
        root, rows = b.address(), b.number(2)
        if filtered:
            raise ValueError("filtered heaps are not read")
        kind = ident[0] >> 4 & 3
        if kind == 2:
            return ident[1 : 2 + (ident[0] & 15)]
        if kind != 0:
            raise ValueError("attributes of many kilobytes are not read")
        wide = (bits + 7) // 8
        offset = int.from_bytes(ident[1 : 1 + wide], "little")
        size_of = min((largest.bit_length() + 6) // 8, (most.bit_length() - 1) // 8 + 1)
        length = int.from_bytes(ident[1 + wide : 1 + wide + size_of], "little")
        if rows == 0:
            return self._raw(root + offset, length)
        direct = (largest // start).bit_length() + 1
        entries = self._over(self._raw(root + 5 + self.wide + wide, min(rows, direct) * table * self.wide), 0)
        begin = 0
        for row in range(min(rows, direct)):
            size = start << max(0, row - 1)
            for _ in range(table):
                to = entries.address()
                if begin <= offset < begin + size:
                    return self._raw(to + offset - begin, length)
                begin += size
        raise ValueError("heaps of nested blocks are not read")

    def _array(self, at: int) -> Array:
        a = Array()
        late = []
        for kind, raw in self._messages(at):
            b = self._over(raw, 0)
            if kind == _SPACE:
                a.shape = self._shape(raw)
            elif kind == _TYPE:
                a.kind = self._kind(raw)
            elif kind == _FILL:
                version = b.number(1)
                if version == 3:
                    there = b.number(1) & 32
                else:
                    b.take(2)
                    there = b.number(1) or version == 1
                a.fill = b.take(b.number(4)) if there and b.at < len(raw) else b""
            elif kind == _FILTERS:
                a.filters = self._filters(raw)
            elif kind == _ATTRIBUTE:
                a.attributes |= self._attribute(raw)
            elif kind == _ATTRIBUTE_INFO:
                b.take(1)
                b.take(2 if b.number(1) & 1 else 0)
                heap, names = b.address(), b.address()
                if heap is not None:
                    for record in self._records(names):
                        a.attributes |= self._attribute(self._heaped(heap, record[:8]))
            elif kind == _LAYOUT:
                late.append(raw)
        for raw in late:
            self._layout(a, self._over(raw, 0))
        return a

    def _layout(self, a: Array, b: _Bytes) -> None:
        version, kind = b.number(1), b.number(1)
        if version not in (3, 4):
            raise ValueError(f"array layout version {version} is not read")
        if kind == 0:
            a.data = b.take(b.number(2))
        elif kind == 1:
            a.at = b.address()
        elif kind == 2 and version == 3:
            rank = b.number(1) - 1
            a.index = ("tree", b.address())
            a.chunk = tuple(b.number(4) for _ in range(rank))
        elif kind == 2:
            flags, rank, width = b.number(1), b.number(1) - 1, b.number(1)
            a.chunk = tuple(b.number(width) for _ in range(rank))
            b.take(width)
            which = b.number(1)
            if which == 1:
                size, mask = (b.length(), b.number(4)) if flags & 2 else (0, 0)
                a.index = ("single", b.address(), size, mask)
            elif which == 2:
                a.index = ("implicit", b.address())
            elif which == 3:
                b.take(1)
                a.index = ("fixed", b.address())
            else:
                raise ValueError("this chunk index is of a later format version; rewrite the file with the default one")
        else:
            raise ValueError("virtual arrays are not read")

    def _shape(self, raw: bytes) -> tuple[int, ...]:
        version, rank = raw[0], raw[1]
        b = self._over(raw, 8 if version == 1 else 4)
        return tuple(b.length() for _ in range(rank))

    def _kind(self, raw: bytes) -> np.dtype | None:
        """Numbers and fixed text; other types are None."""
        which, bits, size = raw[0] & 15, raw[1], int.from_bytes(raw[4:8], "little")
        order = ">" if bits & 1 else "<"
        if which == 0:
            return np.dtype(f"{order}{'i' if bits & 8 else 'u'}{size}")
        if which == 1:
            return np.dtype(f"{order}f{size}")
        return np.dtype(f"S{size}") if which == 3 else None

    def _filters(self, raw: bytes) -> list[tuple[int, tuple[int, ...]]]:
        version, n = raw[0], raw[1]
        b, out = self._over(raw, 8 if version == 1 else 2), []
        for _ in range(n):
            which = b.number(2)
            name = b.number(2) if version == 1 or which >= 256 else 0
            b.take(2)
            count = b.number(2)
            b.take(name + (-name % 8 if version == 1 else 0))
            out.append((which, struct.unpack(f"<{count}I", b.take(4 * count))))
            b.take(4 if version == 1 and count % 2 else 0)
        return out

    def _attribute(self, raw: bytes) -> dict:
        version = raw[0]
        b = self._over(raw, 2)
        sizes = [b.number(2) for _ in range(3)]
        b.take(1 if version == 3 else 0)
        parts = [b.take(n + (-n % 8 if version == 1 else 0))[:n] for n in sizes]
        name, kind, shape = parts[0].rstrip(b"\0").decode(), parts[1], self._shape(parts[2])
        n = int(np.prod(shape, dtype=np.int64))
        if kind[0] & 15 == 9:  # of varying length: texts, or references to dimension scales
            ids = [(b.number(4), b.address(), b.number(4)) for _ in range(n)]
            found = [self._collected(at, k)[: length * (1 if kind[1] & 15 == 1 else int.from_bytes(kind[12:16], "little"))] if length and at is not None else b"" for length, at, k in ids]
            if kind[1] & 15 == 1:
                texts = [x.rstrip(b"\0").decode("utf-8", "replace") for x in found]
                return {name: texts[0] if n == 1 else texts}
            return {name: [int.from_bytes(x[: self.wide], "little") for x in found]} if kind[8] & 15 == 7 else {}
        dtype = self._kind(kind)
        if dtype is None:
            return {}
        values = np.frombuffer(b.take(n * dtype.itemsize), dtype)
        if dtype.kind == "S":
            return {name: b"".join(values.tolist()).decode("utf-8", "replace").rstrip("\0") if n else ""}
        return {name: values}

    def _collected(self, at: int, index: int) -> bytes:
        """An object of a global heap collection."""
        size = int.from_bytes(self._raw(at + 8, self.long), "little")
        b = self._over(self._raw(at, size), 8 + self.long)
        while b.at + 8 + self.long <= size:
            k = b.number(2)
            b.take(6)
            n = b.length()
            if k == 0:
                break
            if k == index:
                return b.take(n)
            b.take(n + -n % 8)
        raise ValueError("no such object in the heap")


def ranges(read, begin: int, step: int, count: int, flat: np.ndarray, kind: np.dtype, gap: int = 1 << 12) -> np.ndarray:
    """[count, cells] of the cells at places `flat` (ascending) of steps that lie `step` bytes apart; nearer than `gap` bytes, cells are read in one go."""
    out = np.zeros((count, len(flat)), kind)
    if not len(flat):
        return out
    if len(flat) * kind.itemsize == step:  # whole steps, side by side
        return np.frombuffer(read(begin, count * step), kind).reshape(count, -1)
    edges = np.flatnonzero(np.diff(flat) * kind.itemsize > gap) + 1
    for own in np.split(np.arange(len(flat)), edges):
        a, b = int(flat[own[0]]), int(flat[own[-1]]) + 1
        for k in range(count):
            raw = np.frombuffer(read(begin + k * step + a * kind.itemsize, (b - a) * kind.itemsize), kind)
            out[k, own] = raw[flat[own] - a]
    return out
