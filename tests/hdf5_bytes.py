"""Writes small HDF5 files byte by byte, in the old layout (symbol tables, headers of version 1) or the new one
(link messages, headers of version 2), for tests of the reader."""

import struct
import zlib

import numpy as np


def kind(dtype, enum=False):
    """The datatype message of a numpy type, of "vlen" strings, or of an enumeration over an integer."""
    if dtype == "vlen":
        return struct.pack("<BBBBI", 0x19, 1, 0, 0, 16) + struct.pack("<BBBBI", 0x13, 0, 0, 0, 1)
    d = np.dtype(dtype)
    if d.kind == "S":
        return struct.pack("<BBBBI", 0x13, 0, 0, 0, d.itemsize)
    big = 1 if d.byteorder == ">" else 0
    if d.kind == "f":
        return struct.pack("<BBBBIHHBBBBI", 0x11, 0x20 | big, 0x3F, 0, d.itemsize, 0, d.itemsize * 8, 52, 11, 0, 52, 1023)
    base = struct.pack("<BBBBIHH", 0x10, big | (8 if d.kind == "i" else 0), 0, 0, d.itemsize, 0, d.itemsize * 8)
    if enum:
        return struct.pack("<BBBBI", 0x18, 1, 0, 0, d.itemsize) + base + b"a\0\0\0\0\0\0\0" + bytes(d.itemsize)
    return base


class Writer:
    def __init__(self, new=False):
        self.new, self.out = new, bytearray(96 if not new else 48)

    def put(self, data):
        self.out += bytes(-len(self.out) % 8)
        at = len(self.out)
        self.out += data
        return at

    def header(self, messages):
        if self.new:
            # the last message goes to a continuation block
            body = b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in messages[:-1])
            k, d = messages[-1]
            more = b"OCHK" + struct.pack("<BHB", k, len(d), 0) + d + bytes(4)
            at = self.put(more)
            body += struct.pack("<BHBQQ", 0x10, 16, 0, at, len(more))
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + bytes(4))
        body = b"".join(struct.pack("<HHBBBB", k, len(d), 0, 0, 0, 0) + d for k, d in ((k, d + bytes(-len(d) % 8)) for k, d in messages))
        return self.put(struct.pack("<BBHIII", 1, 0, len(messages), 1, len(body), 0) + body)

    def heap(self, strings):
        """A global heap; the places of the strings."""
        body = b""
        for k, s in enumerate(strings, 1):
            body += struct.pack("<HHIQ", k, 1, 0, len(s)) + s + bytes(-len(s) % 8)
        body += bytes(16)
        at = self.put(b"GCOL" + struct.pack("<BBBBQ", 1, 0, 0, 0, 16 + len(body)) + body)
        return b"".join(struct.pack("<IQI", len(s), at, k) if s else bytes(16) for k, s in enumerate(strings, 1))

    def attribute(self, name, value):
        name = name.encode() + b"\0"
        if isinstance(value, str):
            k, data = kind("vlen"), self.heap([value.encode()])
        else:
            d = np.dtype("<f8" if isinstance(value, float) else "<i8")
            k, data = kind(d), np.array(value, d).tobytes()
        space = struct.pack("<BBBBI", 1, 0, 0, 0, 0)
        if self.new:
            return 0xC, struct.pack("<BBHHHB", 3, 0, len(name), len(k), len(space), 0) + name + k + space + data
        pad = lambda b: b + bytes(-len(b) % 8)
        return 0xC, struct.pack("<BBHHH", 1, 0, len(name), len(k), len(space)) + pad(name) + pad(k) + pad(space) + data

    def dataset(self, values, dtype=None, chunk=None, filters=(), enum=False, layout=None, attributes=(), drop=()):
        """drop: chunks that aren't written; layout: "compact" or "single" (a chunk without an index)."""
        if dtype == "vlen":
            data, size = self.heap([v.encode() for v in values]), 16
        else:
            arr = np.array(values, dtype)
            dtype, data, size = arr.dtype, arr.tobytes(), arr.dtype.itemsize
        n = len(values)
        messages = [(0x1, struct.pack("<BBBBIQ", 1, 1, 0, 0, 0, n) if not self.new else struct.pack("<BBBBQ", 2, 1, 0, 1, n)), (0x3, kind(dtype, enum))]
        if layout == "compact":
            messages.append((0x8, struct.pack("<BBH", 3, 0, len(data)) + data))
        elif not chunk:
            messages.append((0x8, struct.pack("<BBQQ", 3, 1, self.put(data), len(data))))
        else:
            pieces = []
            for k in range(0, n, chunk):
                if k // chunk in drop:
                    continue
                piece, skipped = data[k * size : (k + chunk) * size].ljust(chunk * size, b"\0"), 0
                for place, f in enumerate(filters):
                    if f == "shuffle":
                        piece = np.frombuffer(piece, np.uint8).reshape(-1, size).T.tobytes()
                    elif f == "deflate":
                        packed = zlib.compress(piece)
                        if k // chunk % 3 == 2:  # some chunks go without
                            skipped |= 1 << place
                        else:
                            piece = packed
                    else:
                        piece += b"sums"
                pieces.append((k, self.put(piece), len(piece), skipped))
            if filters:
                ids = [{"deflate": 1, "shuffle": 2, "fletcher": 3}[f] for f in filters]
                if self.new:
                    body = struct.pack("<BB", 2, len(ids)) + b"".join(struct.pack("<HHHI", i, 0, 1, size if i == 2 else 4) for i in ids)
                else:
                    body = struct.pack("<BB6x", 1, len(ids)) + b"".join(struct.pack("<HHHHI4x", i, 0, 0, 1, size if i == 2 else 4) for i in ids)
                messages.append((0xB, body))
            if layout == "single":
                k, at, length, skipped = pieces[0]
                some = struct.pack("<QI", length, skipped) if filters else b""
                messages.append((0x8, struct.pack("<BBBBBHHB", 4, 2, 2 if filters else 0, 2, 2, chunk, size, 1) + some + struct.pack("<Q", at)))
            else:
                messages.append((0x8, struct.pack("<BBBQII", 3, 2, 2, self.tree(pieces), chunk, size)))
        return self.header(messages + [self.attribute(k, v) for k, v in attributes])

    def tree(self, pieces, width=3):
        """A B-tree of chunks with few entries a node, so that it has levels."""
        level, nodes = 0, [(k, s, m, at) for k, at, s, m in pieces]
        if not nodes:
            return (1 << 64) - 1
        while True:
            above = []
            for lo in range(0, len(nodes), width):
                some = nodes[lo : lo + width]
                body = b"".join(struct.pack("<IIQQQ", s, m, k, 0, at) for k, s, m, at in some) + struct.pack("<IIQQ", 0, 0, 1 << 40, 0)
                at = self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(some), 0, 0) + body)
                above.append((some[0][0], 0, 0, at))
            if len(above) == 1:
                return above[0][3]
            level, nodes = level + 1, above

    def group(self, members, attributes=()):
        more = [self.attribute(k, v) for k, v in attributes]
        if self.new:
            links = [(0x6, struct.pack("<BBB", 1, 0, len(n.encode())) + n.encode() + struct.pack("<Q", at)) for n, at in members.items()]
            return self.header([(0x2, struct.pack("<BBQQ", 0, 0, (1 << 64) - 1, (1 << 64) - 1)), *links, *more, (0, b"")])
        names, places = bytearray(8), {}
        for n in sorted(members):
            places[n] = len(names)
            names += n.encode() + b"\0"
            names += bytes(-len(names) % 8)
        data = self.put(bytes(names))
        heap = self.put(b"HEAP" + struct.pack("<BBBBQQQ", 0, 0, 0, 0, len(names), 1, data))
        tables, order = [], sorted(members)
        for lo in range(0, len(order), 2):
            some = order[lo : lo + 2]
            tables.append(self.put(b"SNOD" + struct.pack("<BBH", 1, 0, len(some)) + b"".join(struct.pack("<QQII16x", places[n], members[n], 0, 0) for n in some)))
        body = struct.pack("<Q", 0) + b"".join(struct.pack("<QQ", t, 0) for t in tables)
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, len(tables), 0, 0) + body)
        return self.header([(0x11, struct.pack("<QQ", tree, heap)), *more])

    def finish(self, path, root):
        sig = b"\x89HDF\r\n\x1a\n"
        if self.new:
            head = sig + struct.pack("<BBBBQQQQI", 2, 8, 8, 0, 0, (1 << 64) - 1, len(self.out), root, 0)
        else:
            head = sig + struct.pack("<BBBBBBBBHHIQQQQ", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0, 0, (1 << 64) - 1, len(self.out), (1 << 64) - 1) + struct.pack("<QQII", 0, root, 0, 0) + bytes(16)
        self.out[: len(head)] = head
        with open(path, "wb") as f:
            f.write(self.out)
