"""Arrays in files of the shared folder, mapped by the workers that read them."""

from __future__ import annotations

import json
import uuid

import numpy as np

from gridloom.llm.runtime import mapped, open_shared

#: bytes of files a worker holds where the shared folder cannot be mapped
HELD_BYTES = 256 << 20


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one file: a JSON directory, then 8-byte aligned data.  Appears whole or not at all."""
    from pyarrow import fs

    at, directory, body = 0, {}, []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a)
        directory[name] = [a.dtype.str, len(a), at]
        body.append(a)
        at += a.nbytes + -a.nbytes % 8
    head = json.dumps(directory).encode()
    head += b" " * (-(len(head) + 8) % 8)
    fs_, path = open_shared(uri)
    fs_.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs_.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for a in body:
            out.write(a.tobytes() + bytes(-a.nbytes % 8))
    try:
        fs_.move(part, path)
    except OSError:  # where a move cannot replace: an earlier attempt of this task has left the same content
        if fs_.get_file_info(path).type == fs.FileType.NotFound:
            raise
        fs_.delete_file(part)


def load(uri: str) -> tuple[dict[str, np.ndarray], int]:
    """Arrays of a file, and the bytes they hold in memory: memory-mapped where the shared folder is a mounted one, else read."""
    raw, held = mapped(uri)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for name, (kind, length, at) in json.loads(raw[8 : 8 + n].tobytes()).items():
        size = np.dtype(kind).itemsize * length
        out[name] = raw[8 + n + at : 8 + n + at + size].view(kind)
    return out, held


class Shelf:
    """Files by name, opened when first needed; where they are read instead of mapped, no more than ``HELD_BYTES`` stay."""

    def __init__(self):
        self._open: dict[str, dict[str, np.ndarray]] = {}
        self._held = 0

    def get(self, uri: str) -> dict[str, np.ndarray]:
        if uri not in self._open:
            arrays, held = load(uri)
            if self._held + held > HELD_BYTES:
                self._open.clear()
                self._held = 0
            self._held += held
            self._open[uri] = arrays
        return self._open[uri]
