"""What of the HDF5 file format tables of columns need: groups, attributes, and one-dimensional datasets.

A dataset is described by its places in the file, so tasks read their own chunks without the metadata of
the whole.  Read are superblocks 0 to 3, object headers 1 and 2, groups of symbol tables and of link
messages, contiguous, compact and chunked layouts (the latter with a B-tree or a single chunk), the filters
deflate, shuffle and Fletcher's checksum (which is skipped), integers, floats, enumerations, and strings of
fixed and variable length.  Anything else is refused by name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np

from ..schema import MatrixError

#: Fixed values of the format: signatures, the undefined address, message types and filters.
SIGNATURE, UNDEFINED = b"\x89HDF\r\n\x1a\n", (1 << 64) - 1
DATASPACE, LINK_INFO, DATATYPE, LINK, LAYOUT, FILTERS, ATTRIBUTE, CONTINUATION, SYMBOL_TABLE = 0x1, 0x2, 0x3, 0x6, 0x8, 0xB, 0xC, 0x10, 0x11
DEFLATE, SHUFFLE, FLETCHER = 1, 2, 3


def open_file(path: str):
    """A local file, or one of a store that pyarrow reaches."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


@dataclass(frozen=True)
class Kind:
    """An element: its numpy type, or for strings of variable length None."""

    size: int
    dtype: str | None
    text: bool = False


@dataclass(frozen=True)
class Chunk:
    """Rows from `start` on, stored in `size` bytes at `at`; skipped: bits of the filters it went without."""

    start: int
    at: int
    size: int
    skipped: int = 0


@dataclass(frozen=True)
class Column:
    """A dataset of `rows` elements in chunks of `step` rows; rows that no chunk holds are zeros.
    inline: a compact dataset's own bytes."""

    kind: Kind
    rows: int
    step: int
    filters: tuple[tuple[int, tuple[int, ...]], ...] = ()
    chunks: tuple[Chunk, ...] = ()
    inline: bytes | None = None

    def part(self, lo: int, hi: int) -> Column:
        """The same with the chunks that hold rows [lo, hi) alone."""
        return replace(self, chunks=tuple(c for c in self.chunks if c.start < hi and c.start + self.step > lo))


def read_rows(f, column: Column, lo: int, hi: int) -> np.ndarray:
    """Rows [lo, hi) as an array, strings as objects."""
    kind = column.kind
    raw = np.dtype(kind.dtype) if kind.dtype else np.dtype("V16")
    out = np.zeros(max(0, hi - lo), raw)
    if column.inline is not None:
        out[:] = np.frombuffer(column.inline, raw, column.rows)[lo:hi]
    for c in column.chunks:
        a, b = max(lo, c.start), min(hi, c.start + column.step, column.rows)
        if a >= b:
            continue
        if column.filters:
            data = _unfiltered(_read(f, c.at, c.size), column, c.skipped)
            out[a - lo : b - lo] = np.frombuffer(data, raw, b - c.start)[a - c.start :]
        else:  # only the rows asked for
            out[a - lo : b - lo] = np.frombuffer(_read(f, c.at + (a - c.start) * raw.itemsize, (b - a) * raw.itemsize), raw)
    if kind.dtype is None:
        return _strings(f, out.tobytes())
    if kind.text:
        return np.array([s.split(b"\0")[0].decode() for s in out.tolist()], dtype=object)
    return out


def _unfiltered(data: bytes, column: Column, skipped: int) -> bytes:
    for k in reversed(range(len(column.filters))):
        if skipped >> k & 1:
            continue
        name, values = column.filters[k]
        if name == DEFLATE:
            data = zlib.decompress(data)
        elif name == FLETCHER:
            data = data[:-4]
        elif name == SHUFFLE:
            size = values[0] if values else column.kind.size
            whole = len(data) // size * size
            data = np.frombuffer(data[:whole], np.uint8).reshape(size, -1).T.tobytes() + data[whole:]
        else:
            raise MatrixError(f"HDF5 filter {name} is not supported")
    return data


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    data = f.read(n)
    if len(data) < n:
        raise MatrixError("the file ends too early")
    return data


def _strings(f, places: bytes) -> np.ndarray:
    """Strings of variable length: each place tells length, collection and number in it."""
    heaps: dict[int, dict[int, bytes]] = {}
    out = []
    for at in range(0, len(places), 16):
        n, heap, index = struct.unpack_from("<IQI", places, at)
        if not n:
            out.append("")
            continue
        if heap not in heaps:
            if len(heaps) > 64:
                heaps.clear()
            heaps[heap] = _collection(f, heap)
        out.append(heaps[heap][index][:n].split(b"\0")[0].decode())
    return np.array(out, dtype=object)


def _collection(f, at: int) -> dict[int, bytes]:
    head = _read(f, at, 16)
    if head[:4] != b"GCOL":
        raise MatrixError("no HDF5 heap where one should be")
    data, out, k = _read(f, at, struct.unpack_from("<Q", head, 8)[0]), {}, 16
    while k + 16 <= len(data):
        index, _, _, n = struct.unpack_from("<HHIQ", data, k)
        if not index:
            break
        out[index] = data[k + 16 : k + 16 + n]
        k += 16 + -(-n // 8) * 8
    return out


def _kind(data: bytes) -> Kind:
    kind, bits, size = data[0] & 15, data[1], struct.unpack_from("<I", data, 4)[0]
    order = ">" if bits & 1 else "<"
    if kind == 0:
        return Kind(size, f"{order}{'i' if bits & 8 else 'u'}{size}")
    if kind == 1:
        return Kind(size, f"{order}f{size}")
    if kind == 3:
        return Kind(size, f"S{size}", True)
    if kind == 8:  # an enumeration is stored as its base
        return _kind(data[8:])
    if kind == 9 and bits & 15 == 1:
        return Kind(16, None, True)
    raise MatrixError(f"HDF5 type {kind} is not supported")


def _shape(data: bytes) -> tuple[int, ...]:
    return struct.unpack_from(f"<{data[1]}Q", data, 8 if data[0] == 1 else 4)


@dataclass
class Node:
    """An object: the messages of its header."""

    file: File
    messages: list[tuple[int, bytes]] = field(default_factory=list)

    def of(self, kind: int) -> list[bytes]:
        return [data for k, data in self.messages if k == kind]

    def members(self) -> dict[str, int]:
        """The addresses of a group's members by name; none of a dataset."""
        out = {}
        for data in self.of(LINK):
            name, at = _link(data)
            out[name] = at
        for data in self.of(SYMBOL_TABLE):
            tree, heap = struct.unpack_from("<QQ", data)
            out |= self.file.symbols(tree, heap)
        for data in self.of(LINK_INFO):
            at = 2 + 8 * (data[1] & 1)
            if struct.unpack_from("<Q", data, at)[0] != UNDEFINED:
                raise MatrixError("HDF5 groups with dense links are not supported")
        return out

    def child(self, path: str) -> Node | None:
        node = self
        for name in filter(None, path.split("/")):
            at = node.members().get(name)
            if at is None:
                return None
            node = self.file.node(at)
        return node

    def attributes(self) -> dict[str, object]:
        """Scalar attributes; others and those of unknown types are left out."""
        out = {}
        for data in self.of(ATTRIBUTE):
            n, kind_size, shape_size = struct.unpack_from("<HHH", data, 2)
            at = 8 + (data[0] == 3)
            pad = (lambda k: -(-k // 8) * 8) if data[0] == 1 else (lambda k: k)
            name = data[at : at + n].split(b"\0")[0].decode()
            kind_at = at + pad(n)
            shape_at = kind_at + pad(kind_size)
            try:
                kind, shape = _kind(data[kind_at:shape_at]), _shape(data[shape_at:])
            except MatrixError:
                continue
            value = data[shape_at + pad(shape_size) :][: kind.size]
            if all(k == 1 for k in shape) and len(value) == kind.size:
                got = read_rows(self.file.f, Column(kind, 1, 1, inline=value), 0, 1)[0]
                out[name] = got if isinstance(got, str) else got.item()
        return out

    def column(self) -> Column:
        kind, shape = _kind(self.of(DATATYPE)[0]), _shape(self.of(DATASPACE)[0])
        if len(shape) != 1:
            raise MatrixError(f"an HDF5 dataset of {len(shape)} dimensions")
        filters = tuple(_filters(self.of(FILTERS)[0])) if self.of(FILTERS) else ()
        layout, rows = self.of(LAYOUT)[0], shape[0]
        version, of = layout[0], layout[1]
        if version not in (3, 4):
            raise MatrixError(f"HDF5 layout version {version} is not supported")
        if of == 0:
            n = struct.unpack_from("<H", layout, 2)[0]
            return Column(kind, rows, rows, inline=layout[4 : 4 + n])
        if of == 1:
            at, size = struct.unpack_from("<QQ", layout, 2)
            return Column(kind, rows, rows, chunks=() if at == UNDEFINED else (Chunk(0, at, size),))
        if of == 2 and version == 3:
            tree, step = struct.unpack_from("<QI", layout, 3)
            return Column(kind, rows, step, filters, () if tree == UNDEFINED else tuple(self.file.chunks(tree)))
        if of == 2 and layout[4] and layout[5 + layout[3] * layout[4]] == 1:
            width, at = layout[4], 6 + layout[3] * layout[4]
            step = int.from_bytes(layout[5 : 5 + width], "little")
            size, skipped = struct.unpack_from("<QI", layout, at) if layout[2] & 2 else (step * kind.size, 0)
            where = struct.unpack_from("<Q", layout, at + (12 if layout[2] & 2 else 0))[0]
            return Column(kind, rows, step, filters, () if where == UNDEFINED else (Chunk(0, where, size, skipped),))
        raise MatrixError("an HDF5 chunk index of the newer kinds is not supported; repack the file")


def _filters(data: bytes) -> Iterator[tuple[int, tuple[int, ...]]]:
    at = 8 if data[0] == 1 else 2
    for _ in range(data[1]):
        name = struct.unpack_from("<H", data, at)[0]
        named = data[0] == 1 or name >= 256
        n, at = (struct.unpack_from("<H", data, at + 2)[0], at + 4) if named else (0, at + 2)
        values = struct.unpack_from("<H", data, at + 2)[0]
        at += 4 + (-(-n // 8) * 8 if data[0] == 1 else n)
        yield name, struct.unpack_from(f"<{values}I", data, at)
        at += 4 * (values + (values % 2 if data[0] == 1 else 0))


def _link(data: bytes) -> tuple[str, int]:
    flags, at = data[1], 2
    kind, at = (data[at], at + 1) if flags & 8 else (0, at)
    at += (8 if flags & 4 else 0) + (1 if flags & 16 else 0)
    width = 1 << (flags & 3)
    n = int.from_bytes(data[at : at + width], "little")
    at += width
    if kind:
        raise MatrixError("HDF5 links other than hard ones are not supported")
    return data[at : at + n].decode(), struct.unpack_from("<Q", data, at + n)[0]


class File:
    def __init__(self, f):
        self.f, self.base = f, 0
        f.seek(0, 2)
        end, at = f.tell(), 0
        while at + 8 <= end and _read(f, at, 8) != SIGNATURE:
            at = at * 2 or 512
        if at + 8 > end:
            raise MatrixError("no HDF5 file")
        if at:
            raise MatrixError("HDF5 files with a user block are not supported")
        head = _read(f, 0, min(end, 112))
        version = head[8]
        sizes = head[13:15] if version < 2 else head[9:11]
        if version > 3 or sizes != b"\x08\x08":
            raise MatrixError(f"HDF5 superblock {version} with addresses of {sizes[0]} bytes is not supported")
        self.root_at = struct.unpack_from("<Q", head, (64, 68, 36, 36)[version])[0]

    def root(self) -> Node:
        return self.node(self.root_at)

    def node(self, at: int) -> Node:
        head = _read(self.f, at, 16)
        out = Node(self)
        if head[:4] == b"OHDR":
            flags, k = head[5], 6
            k += (16 if flags & 32 else 0) + (4 if flags & 16 else 0)
            width = 1 << (flags & 3)
            size = int.from_bytes(_read(self.f, at + k, width), "little")
            blocks, new = [(at + k + width, size)], flags
        elif head[0] == 1:
            blocks, new = [(at + 16, struct.unpack_from("<I", head, 8)[0])], None
        else:
            raise MatrixError("no HDF5 object header where one should be")
        while blocks:
            start, size = blocks.pop(0)
            data, k = _read(self.f, start, size), 0
            if new is not None and data[:4] == b"OCHK":
                data, k = data[:-4], 4
            while k + (8 if new is None else 4) <= len(data):
                if new is None:
                    kind, n = struct.unpack_from("<HH", data, k)
                    k += 8
                else:
                    kind, n = struct.unpack_from("<BH", data, k)
                    k += 6 if new & 4 else 4
                body = data[k : k + n]
                k += n
                if kind == CONTINUATION:
                    blocks.append(struct.unpack_from("<QQ", body))
                else:
                    out.messages.append((kind, body))
        return out

    def _tree(self, at: int, kind: int) -> tuple[int, int, bytes]:
        """Level, number of entries and entries of a B-tree's node."""
        head = _read(self.f, at, 24)
        if head[:4] != b"TREE" or head[4] != kind:
            raise MatrixError("no HDF5 B-tree where one should be")
        n = struct.unpack_from("<H", head, 6)[0]
        return head[5], n, _read(self.f, at + 24, n * (16 if kind == 0 else 32))

    def symbols(self, tree: int, heap: int) -> dict[str, int]:
        head = _read(self.f, heap, 32)
        names = _read(self.f, struct.unpack_from("<Q", head, 24)[0], struct.unpack_from("<Q", head, 8)[0])
        out, todo = {}, [tree]
        while todo:
            level, n, data = self._tree(todo.pop(), 0)
            below = [struct.unpack_from("<Q", data, 16 * k + 8)[0] for k in range(n)]
            if level:
                todo += below
                continue
            for at in below:
                n_symbols = struct.unpack_from("<H", _read(self.f, at, 8), 6)[0]
                table = _read(self.f, at + 8, 40 * n_symbols)
                for k in range(n_symbols):
                    name, where = struct.unpack_from("<QQ", table, 40 * k)
                    out[names[name : names.index(b"\0", name)].decode()] = where
        return out

    def chunks(self, tree: int) -> list[Chunk]:
        """Of a dataset of one dimension: a key has size, filter bits, row and a zero."""
        out, todo = [], [tree]
        while todo:
            level, n, data = self._tree(todo.pop(), 1)
            for k in range(n):
                size, skipped, row, _, at = struct.unpack_from("<IIQQQ", data, 32 * k)
                if level:
                    todo.append(at)
                else:
                    out.append(Chunk(row, at, size, skipped))
        return sorted(out, key=lambda c: c.start)
