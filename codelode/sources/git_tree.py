"""The files that a Git repository tracks, as a data source: spark.read.format("git_tree").option("path", ...).load().

Partitions are ranges of the index (or, of a commit, the entries of its top folder); each task reads its own part of the index or walks
its own folders, and takes contents from loose objects or packs. Nothing but the number of entries, or one folder, passes the driver.
The repository must lie where driver and executors can open it. Only formats are implemented here: index 2 to 4, loose objects, packs
with their indices of version 2, deltas, alternates.
"""

from __future__ import annotations

import mmap
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_path string, mode int, blob string, size long, content binary"
#: Modes of links to other repositories and of folders, and the kinds of objects in packs.
SUBMODULE, FOLDER = 0o160000, 0o040000
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}


def git_dir(path: str) -> str:
    """The folder of a repository's objects: path/.git, what a .git file names, or path itself if it is bare."""
    at = os.path.join(path, ".git")
    if os.path.isfile(at):
        with open(at) as f:
            at = os.path.join(path, f.read().split("gitdir:", 1)[1].strip())
    at = at if os.path.isdir(at) else path
    if not os.path.exists(os.path.join(at, "HEAD")):
        raise ValueError(f"{path} is no Git repository")
    return at


def _varint(data, at: int) -> tuple[int, int]:
    """A number as offsets of deltas and prefixes of index 4 are written: 7 bits a byte, one added at each that goes on."""
    byte = data[at]
    n, at = byte & 127, at + 1
    while byte & 128:
        byte = data[at]
        n, at = (n + 1 << 7) | byte & 127, at + 1
    return n, at


def _size(data, at: int, n: int, shift: int) -> tuple[int, int]:
    """A number of 7 bits a byte, the lowest first."""
    while True:
        n |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if not data[at - 1] & 128:
            return n, at


def _patched(base: bytes, delta: bytes) -> bytes:
    _, at = _size(delta, 0, 0, 0)
    _, at = _size(delta, at, 0, 0)
    out = []
    while at < len(delta):
        op, at = delta[at], at + 1
        if op & 128:
            place = length = 0
            for i in range(7):
                if op >> i & 1:
                    place, length = (place | delta[at] << 8 * i, length) if i < 4 else (place, length | delta[at] << 8 * (i - 4))
                    at += 1
            out.append(base[place : place + (length or 0x10000)])
        else:
            out.append(delta[at : at + op])
            at += op
    return b"".join(out)


class Objects:
    """Objects of a repository by their hash."""

    def __init__(self, git: str):
        common = os.path.join(git, "commondir")
        if os.path.isfile(common):
            with open(common) as f:
                git = os.path.join(git, f.read().strip())
        self.folders, self.packs = [os.path.join(git, "objects")], []
        for folder in self.folders:
            more = os.path.join(folder, "info", "alternates")
            if os.path.isfile(more):
                with open(more) as f:
                    self.folders += [os.path.join(folder, x.strip()) for x in f if x.strip()]
            packs = os.path.join(folder, "pack")
            for name in sorted(os.listdir(packs)) if os.path.isdir(packs) else []:
                if name.endswith(".idx"):
                    self.packs.append((self._mapped(os.path.join(packs, name)), os.path.join(packs, name[:-4] + ".pack"), {}))

    @staticmethod
    def _mapped(path: str) -> mmap.mmap:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    def read(self, sha: bytes) -> tuple[str, bytes]:
        """Kind and content of an object; a KeyError if the repository lacks it."""
        name = sha.hex()
        for folder in self.folders:
            path = os.path.join(folder, name[:2], name[2:])
            if os.path.exists(path):
                with open(path, "rb") as f:
                    head, _, body = zlib.decompress(f.read()).partition(b"\0")
                return head.split()[0].decode(), body
        for index, pack, opened in self.packs:
            at = self._offset(index, sha)
            if at is not None:
                if "data" not in opened:
                    opened["data"] = self._mapped(pack)
                return self._entry(opened["data"], at)
        raise KeyError(name)

    @staticmethod
    def _offset(index: mmap.mmap, sha: bytes) -> int | None:
        if index[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError("a pack index of version 2 is needed")
        fan = lambda i: int.from_bytes(index[8 + 4 * i : 12 + 4 * i]) if i >= 0 else 0
        n, low, high = fan(255), fan(sha[0] - 1), fan(sha[0])
        while low < high:
            mid = (low + high) // 2
            here = index[1032 + 20 * mid : 1052 + 20 * mid]
            if here == sha:
                at = int.from_bytes(index[(p := 1032 + 24 * n + 4 * mid) : p + 4])
                return int.from_bytes(index[(p := 1032 + 28 * n + 8 * (at & 0x7FFFFFFF)) : p + 8]) if at >> 31 else at
            low, high = (mid + 1, high) if here < sha else (low, mid)
        return None

    def _entry(self, data: mmap.mmap, at: int) -> tuple[str, bytes]:
        deltas = []
        while True:  # down a chain of deltas to a whole object
            start, first = at, data[at]
            kind, at = first >> 4 & 7, at + 1
            if first & 128:
                _, at = _size(data, at, first & 15, 4)
            base = sha = None
            if kind == 6:
                back, at = _varint(data, at)
                base = start - back
            elif kind == 7:
                sha, at = data[at : at + 20], at + 20
            body = self._inflated(data, at)
            if kind in KINDS:
                break
            deltas.append(body)
            if sha is not None:
                name, body = self.read(sha)
                break
            at = base
        name = KINDS.get(kind) or name
        for delta in reversed(deltas):
            body = _patched(body, delta)
        return name, body

    @staticmethod
    def _inflated(data: mmap.mmap, at: int) -> bytes:
        z, out = zlib.decompressobj(), []
        while not z.eof:
            out.append(z.decompress(data[at : at + (1 << 16)]))
            at += 1 << 16
        return b"".join(out)

    def resolve(self, git: str, name: str) -> bytes:
        """The hash of a commit's tree; name is a full hash, a branch, a tag or HEAD."""
        for at in (git, os.path.dirname(self.folders[0])):
            for place in ("", "refs/heads/", "refs/tags/", "refs/remotes/"):
                if os.path.isfile(path := os.path.join(at, place + name)):
                    with open(path) as f:
                        value = f.read().strip()
                    return self.resolve(git, value[5:]) if value.startswith("ref: ") else self._tree(bytes.fromhex(value))
            if os.path.isfile(path := os.path.join(at, "packed-refs")):
                with open(path) as f:
                    known = {r: h for h, _, r in (line.strip().partition(" ") for line in f if line[0] not in "#^")}
                for place in ("", "refs/heads/", "refs/tags/", "refs/remotes/"):
                    if place + name in known:
                        return self._tree(bytes.fromhex(known[place + name]))
        if len(name) == 40 and not set(name) - set("0123456789abcdef"):
            return self._tree(bytes.fromhex(name))
        raise ValueError(f"no commit {name}")

    def _tree(self, sha: bytes) -> bytes:
        kind, body = self.read(sha)
        return sha if kind == "tree" else self._tree(bytes.fromhex(body.split(b"\n", 1)[0].split()[1].decode()))

    def entries(self, tree: bytes) -> Iterator[tuple[bytes, int, bytes]]:
        """Name, mode and hash of what a tree holds."""
        body, at = self.read(tree)[1], 0
        while at < len(body):
            end = body.index(b"\0", at)
            mode, _, name = body[at:end].partition(b" ")
            yield name, int(mode, 8), body[end + 1 : end + 21]
            at = end + 21


def index_length(git: str) -> int:
    path = os.path.join(git, "index")
    if not os.path.exists(path):
        return 0
    with open(path, "rb") as f:
        head = f.read(12)
    if head[:4] != b"DIRC" or not 2 <= int.from_bytes(head[4:8]) <= 4:
        raise ValueError("an index of version 2 to 4 is needed")
    return int.from_bytes(head[8:12])


def index_entries(git: str, start: int, stop: int) -> Iterator[tuple[bytes, int, bytes]]:
    """Path, mode and hash of the entries from start to stop; of a conflict, each side's."""
    with open(os.path.join(git, "index"), "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    version, at, path = int.from_bytes(data[4:8]), 12, b""
    for i in range(stop):
        mode, sha, flags = int.from_bytes(data[at + 24 : at + 28]), data[at + 40 : at + 60], int.from_bytes(data[at + 60 : at + 62])
        name = at + (64 if flags & 0x4000 else 62)
        if version == 4:
            cut, name = _varint(data, name)
            end = data.find(b"\0", name)
            path, at = path[: len(path) - cut] + data[name:end], end + 1
        else:
            end = data.find(b"\0", name)
            path = data[name:end]
            at += (end - at + 8) // 8 * 8
        if i >= start:
            yield path, mode, sha


class _Part(InputPartition):
    def __init__(self, start: int = 0, stop: int = 0, entries: list | None = None):
        self.start, self.stop, self.entries = start, stop, entries


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.ref = options["path"].removeprefix("file://"), options.get("ref")
        self.each, self.largest, self.whole = int(options.get("filesperpartition", 5000)), int(options.get("maxsize", 1 << 20)), options.get("content", "true").lower() == "true"

    def partitions(self) -> list[_Part]:
        git = git_dir(self.path)
        if self.ref:
            objects = Objects(git)
            top = sorted(objects.entries(objects.resolve(git, self.ref)), key=lambda e: e[1] == FOLDER)  # files, then folders one by one
            files = [e for e in top if e[1] != FOLDER]
            parts = [_Part(entries=files[i : i + self.each]) for i in range(0, len(files), self.each)] + [_Part(entries=[e]) for e in top if e[1] == FOLDER]
            return parts or [_Part(entries=[])]
        n = index_length(git)
        return [_Part(i, min(i + self.each, n)) for i in range(0, n, self.each)] or [_Part(entries=[])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        git = git_dir(self.path)
        objects = Objects(git)
        if partition.entries is None:
            yield from (self._row(objects, *e) for e in index_entries(git, partition.start, partition.stop))
            return
        left = list(reversed(partition.entries))
        while left:
            path, mode, sha = left.pop()
            if mode == FOLDER:
                left += [(path + b"/" + name, m, s) for name, m, s in reversed(list(objects.entries(sha)))]
            else:
                yield self._row(objects, path, mode, sha)

    def _row(self, objects: Objects, path: bytes, mode: int, sha: bytes) -> tuple:
        body = None if mode == SUBMODULE or not self.whole else objects.read(sha)[1]
        return path.decode("utf-8", "replace"), mode, sha.hex(), None if body is None else len(body), None if body is None or len(body) >= self.largest else body


class GitTree(DataSource):
    """Rows of tracked files: file_path, mode, blob (hash), size and content.

    Options: path; ref (a branch, tag, HEAD or full hash; without it, the index, so what `git ls-files` lists); content (false: names and
    hashes only); maxSize (content of files as large or larger is null, 1 MiB); filesPerPartition (5000). Links to other repositories have
    neither size nor content; a symbolic link's content is its target.
    """

    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitTree)
