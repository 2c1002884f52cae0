"""Small NetCDF-4 files, written by hand from the HDF5 format's description, for tests of the reader.

Old style: superblock 0, object headers 1, links in a symbol table.  New style: superblock 2, object
headers 2, links as messages; more than eight attributes go to a fractal heap.
"""

from __future__ import annotations

import struct
import zlib
from itertools import product

import numpy as np

NONE = b"\xff" * 8


def pad(raw: bytes, n: int = 8) -> bytes:
    return raw + b"\0" * (-len(raw) % n)


def u(n: int, width: int = 8) -> bytes:
    return n.to_bytes(width, "little")


class Maker:
    def __init__(self, new: bool):
        self.new, self.out = new, bytearray(96)

    def put(self, raw: bytes) -> int:
        self.out += b"\0" * (-len(self.out) % 8)
        self.out += raw
        return len(self.out) - len(raw)

    def space(self, shape) -> bytes:
        dims = b"".join(u(n) for n in shape)
        return bytes([2, len(shape), 0, 1 if shape else 0]) + dims if self.new else bytes([1, len(shape), 0, 0]) + bytes(4) + dims

    def kind(self, dtype) -> bytes:
        dtype = np.dtype(dtype)
        n, big = dtype.itemsize, int(dtype.byteorder == ">")
        if dtype.kind == "S":
            return bytes([0x13, 0, 0, 0]) + u(n, 4)
        if dtype.kind == "f":
            about = {4: (31, 23, 8, 0, 23, 127), 8: (63, 52, 11, 0, 52, 1023)}[n]
            return bytes([0x11, 0x20 | big, about[0], 0]) + u(n, 4) + struct.pack("<HHBBBBI", 0, 8 * n, *about[1:])
        return bytes([0x10, big | (8 if dtype.kind == "i" else 0), 0, 0]) + u(n, 4) + struct.pack("<HH", 0, 8 * n)

    def attribute(self, name: str, value) -> bytes:
        if isinstance(value, list):  # references to dimension scales, each a sequence of one
            heap = self.collection([u(at) for at in value])
            kind, shape = bytes([0x19, 0, 0, 0]) + u(16, 4) + bytes([0x17, 0, 0, 0]) + u(8, 4), (len(value),)
            data = b"".join(u(1, 4) + u(heap) + u(k + 1, 4) for k in range(len(value)))
        elif isinstance(value, tuple):  # a text of varying length
            raw = value[0].encode()
            kind, shape, data = bytes([0x19, 1, 0, 0]) + u(16, 4) + bytes([0x13, 0, 0, 0]) + u(1, 4), (), u(len(raw), 4) + u(self.collection([raw])) + u(1, 4)
        elif isinstance(value, str):
            data = value.encode() + b"\0"
            kind, shape = self.kind(f"S{len(data)}"), ()
        else:
            value = np.asarray(value)
            kind, shape, data = self.kind(value.dtype), value.shape, value.tobytes()
        parts, space = name.encode() + b"\0", self.space(shape)
        sizes = b"".join(u(len(x), 2) for x in (parts, kind, space))
        return bytes([3, 0]) + sizes + b"\0" + parts + kind + space + data if self.new else bytes([1, 0]) + sizes + pad(parts) + pad(kind) + pad(space) + data

    def collection(self, objects: list[bytes]) -> int:
        body = b"".join(u(k, 2) + u(1, 2) + bytes(4) + u(len(x)) + pad(x) for k, x in enumerate(objects, 1))
        body += bytes(2) + bytes(6) + u(0)
        return self.put(b"GCOL" + bytes([1, 0, 0, 0]) + u(16 + len(body)) + body)

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        """An object header in two blocks, joined by a continuation."""
        first, rest = messages[: len(messages) // 2], messages[len(messages) // 2 :]
        if self.new:
            body = lambda ms: b"".join(bytes([t]) + u(len(m), 2) + b"\0" + m for t, m in ms)
            more = b"OCHK" + body(rest) + bytes(4)
            first = [*first, (0x10, u(self.put(more)) + u(len(more)))]
            return self.put(b"OHDR" + bytes([2, 2]) + u(len(body(first)), 4) + body(first) + bytes(4))
        body = lambda ms: b"".join(u(t, 2) + u(len(pad(m)), 2) + bytes(4) + pad(m) for t, m in ms)
        more = body(rest)
        first = [*first, (0x10, u(self.put(more)) + u(len(more)))]
        return self.put(bytes([1, 0]) + u(len(messages) + 1, 2) + u(1, 4) + u(len(body(first)), 4) + bytes(4) + body(first))

    def dense(self, attributes: list[bytes]) -> bytes:
        """Attribute info: a fractal heap of one block (or of a table of blocks) and its index of names."""
        block, ids, at = bytearray(), [], 0
        prefix, start = 4 + 1 + 8 + 4 + 4, 512
        blocks, sizes = [], [start, start, start, start, start, start, start, start, 2 * start, 2 * start, 2 * start, 2 * start, 4 * start, 4 * start, 4 * start, 4 * start, 8 * start, 8 * start, 8 * start, 8 * start]
        begin = 0
        block = bytearray(prefix)
        for raw in attributes:
            if len(block) + len(raw) > sizes[len(blocks)]:
                blocks.append(bytes(block).ljust(sizes[len(blocks)], b"\0"))
                begin += len(blocks[-1])
                block = bytearray(prefix)
            ids.append(b"\0" + u(begin + len(block), 4) + u(len(raw), 2) + b"\0")
            block += raw
        blocks.append(bytes(block).ljust(sizes[len(blocks)], b"\0"))
        places = [self.put(b"FHDB" + b"\0" + u(0) + u(0, 4) + bytes(4) + x[prefix:]) for x in blocks]
        rows = 0
        root = places[0]
        if len(blocks) > 1:
            rows = -(-len(blocks) // 4)
            table = [u(p) for p in places] + [NONE] * (rows * 4 - len(places))
            root = self.put(b"FHIB" + b"\0" + u(0) + u(0, 4) + b"".join(table) + bytes(4))
        heap = self.put(b"FRHP" + b"\0" + u(8, 2) + u(0, 2) + b"\2" + u(4096, 4) + u(0) + NONE + u(0) + NONE + 8 * u(0) + u(4, 2) + u(start) + u(65536) + u(32, 2) + u(1, 2) + u(root) + u(rows, 2) + bytes(4))
        records = [i + b"\0" + u(k, 4) + bytes(4) for k, i in enumerate(ids)]
        leaf = lambda rs: self.put((b"BTLF" + b"\0" + bytes([8]) + b"".join(rs) + bytes(4)).ljust(512, b"\0"))
        if len(records) <= 20:
            top, depth, held = leaf(records), 0, len(records)
        else:
            half = len(records) // 2
            a, b = leaf(records[:half]), leaf(records[half + 1 :])
            top, depth, held = self.put((b"BTIN" + b"\0" + bytes([8]) + records[half] + u(a) + u(half, 1) + u(b) + u(len(records) - half - 1, 1) + bytes(4)).ljust(512, b"\0")), 1, 1
        tree = self.put(b"BTHD" + b"\0" + bytes([8]) + u(512, 4) + u(17, 2) + u(depth, 2) + bytes([100, 40]) + u(top) + u(held, 2) + u(len(records)) + bytes(4))
        return b"\0\0" + u(heap) + u(tree)

    def array(self, values: np.ndarray, attributes: dict, chunk=None, filters=(), fill=None, index="tree", leaf=4, skip=lambda o: False) -> int:
        """An array; chunked ones with the filters given, without the chunks whose offset is skipped."""
        messages = [(0x01, self.space(values.shape)), (0x03, self.kind(values.dtype))]
        if fill is not None:
            raw = np.asarray(fill, values.dtype).tobytes()
            messages.append((0x05, bytes([3, 0x2A]) + u(len(raw), 4) + raw if self.new else bytes([2, 2, 2, 1]) + u(len(raw), 4) + raw))
        if chunk is None:
            messages.append((0x08, bytes([3, 1]) + u(self.put(values.tobytes())) + u(values.nbytes)))
        else:
            size = values.dtype.itemsize
            client = {1: (4,), 2: (size,), 3: ()}
            if filters and self.new:
                messages.append((0x0B, bytes([2, len(filters)]) + b"".join(u(f, 2) + u(0, 2) + u(len(client[f]), 2) + b"".join(u(x, 4) for x in client[f]) for f in filters)))
            elif filters:
                messages.append((0x0B, bytes([1, len(filters)]) + bytes(6) + b"".join(u(f, 2) + u(8, 2) + u(0, 2) + u(len(client[f]), 2) + b"filter\0\0" + b"".join(u(x, 4) for x in client[f]) + bytes(4 * (len(client[f]) % 2)) for f in filters)))
            stored = []
            for offset in product(*(range(0, n, c) for n, c in zip(values.shape, chunk))):
                part = values[tuple(slice(o, o + c) for o, c in zip(offset, chunk))]
                whole = np.zeros(chunk, values.dtype)
                whole[tuple(map(slice, part.shape))] = part
                raw = whole.tobytes()
                for f in filters:
                    raw = np.frombuffer(raw, np.uint8).reshape(-1, size).T.tobytes() if f == 2 else zlib.compress(raw, 4) if f == 1 else raw + bytes(4)
                stored.append((offset, None if skip(offset) else self.put(raw), len(raw)))
            messages.append((0x08, self.layout(values, chunk, filters, stored, index, leaf)))
        made = [self.attribute(k, v) for k, v in attributes.items()]
        if self.new and len(made) > 8:
            messages.append((0x15, self.dense(made)))
        else:
            messages += [(0x0C, m) for m in made]
        return self.header(messages)

    def layout(self, values, chunk, filters, stored, index, leaf) -> bytes:
        size, rank = values.dtype.itemsize, len(chunk)
        dims = [*chunk, size]
        if index == "tree":
            there = [x for x in stored if x[1] is not None]
            key = lambda offset, n: u(n, 4) + u(0, 4) + b"".join(u(o) for o in offset) + u(0)
            last = key((values.shape[0] + chunk[0],) + (0,) * (rank - 1), 0)

            def node(level, entries, end):  # entries: (key, address)
                return self.put(b"TREE" + bytes([1, level]) + u(len(entries), 2) + NONE + NONE + b"".join(k + u(at) for k, at in entries) + end)

            entries = [(key(o, n), at) for o, at, n in there]
            level = 0
            while level == 0 or len(entries) > leaf:
                groups = [entries[k : k + leaf] for k in range(0, len(entries), leaf)]
                ends = [g[0][0] for g in groups[1:]] + [last]
                entries = [(g[0][0], node(level, g, e)) for g, e in zip(groups, ends)]
                level += 1
            root = entries[0][1] if len(entries) == 1 else node(level, entries, last)
            return bytes([3, 2, rank + 1]) + u(root) + b"".join(u(d, 4) for d in dims)
        head = bytes([4, 2, 2 if index == "single" and filters else 0, rank + 1, 4]) + b"".join(u(d, 4) for d in dims)
        if index == "single":
            return head + b"\1" + (u(stored[0][2]) + u(0, 4) if filters else b"") + u(stored[0][1])
        if index == "implicit":
            return head + b"\2" + u(self.put(b"".join(bytes(self.out[at : at + n]) for _, at, n in stored)))
        entry = lambda at, n: (NONE if at is None else u(at)) + (u(n, 3) + u(0, 4) if filters else b"")
        width = 15 if filters else 8
        block = self.put(b"FADB" + bytes([0, int(bool(filters))]) + u(0) + b"".join(entry(at, n) for _, at, n in stored) + bytes(4))
        fixed = self.put(b"FAHD" + bytes([0, int(bool(filters)), width, 10]) + u(len(stored)) + u(block) + bytes(4))
        return head + b"\3" + bytes([10]) + u(fixed)

    def close(self, path: str, links: dict[str, int]) -> None:
        if self.new:
            link = lambda n, at: bytes([1, 0, len(n.encode())]) + n.encode() + u(at)
            root = self.header([(0x02, b"\0\0" + NONE + NONE), *((0x06, link(n, at)) for n, at in links.items())])
            head = b"\x89HDF\r\n\x1a\n" + bytes([2, 8, 8, 0]) + u(0) + NONE + u(len(self.out)) + u(root) + bytes(4)
        else:
            text, at = bytearray(8), {}
            for n in sorted(links):
                at[n] = len(text)
                text += pad(n.encode() + b"\0")
            heap = self.put(b"HEAP" + bytes(4) + u(len(text)) + NONE + u(self.put(bytes(text))))
            entry = lambda name, to: u(name) + u(to) + bytes(24)
            leaf = self.put(b"SNOD" + bytes([1, 0]) + u(len(links), 2) + b"".join(entry(at[n], links[n]) for n in sorted(links)))
            tree = self.put(b"TREE" + bytes([0, 0]) + u(1, 2) + NONE + NONE + u(0) + u(leaf) + u(at[max(links)]))
            root = self.header([(0x11, u(tree) + u(heap)), (0x00, bytes(8))])
            head = b"\x89HDF\r\n\x1a\n" + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + u(4, 2) + u(16, 2) + u(0, 4) + u(0) + NONE + u(len(self.out)) + NONE + u(0) + u(root) + bytes(24)
        self.out[: len(head)] = head
        with open(path, "wb") as f:
            f.write(self.out)


def write_cube4(path, variable, values, lat, lon, times=None, units="days since 1850-1-1", new=False, chunk=None, filters=(2, 1), attributes=None, dtype=">f8", **more) -> None:
    """A cube as `netcdf.write_cube` writes one, in NetCDF-4."""
    m = Maker(new)
    scale = lambda n: {"CLASS": "DIMENSION_SCALE", "NAME": n}
    links = {}
    if times is not None:
        links["time"] = m.array(np.asarray(times, "<f8"), scale("time") | {"units": (units,) if new else units, "calendar": "standard"}, chunk=(4,), filters=())
    links["lat"] = m.array(np.asarray(lat, "<f4"), scale("lat") | {"units": "degrees_north"})
    links["lon"] = m.array(np.asarray(lon, "<f8"), scale("lon"))
    names = ["time"] * (times is not None) + ["lat", "lon"]
    links[variable] = m.array(np.asarray(values).astype(dtype), {"DIMENSION_LIST": [links[n] for n in names]} | (attributes or {}), chunk=chunk, filters=filters if chunk else (), **more)
    m.close(path, links)
