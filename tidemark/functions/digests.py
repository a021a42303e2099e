"""SHA-256 over pieces of a file that different tasks read: what one leaves, the next takes up."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from functools import cache


class _Context(ctypes.Structure):
    """libcrypto's SHA256_CTX."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("held", ctypes.c_uint), ("size", ctypes.c_uint)]


class Sha256:
    """As hashlib's, but with its state as bytes; hashlib gives out none."""

    def __init__(self, state: bytes | None, library: ctypes.CDLL):
        self.library = library
        self.context = _Context.from_buffer_copy(state) if state else _Context()
        if not state:
            library.SHA256_Init(ctypes.byref(self.context))

    def update(self, data: bytes) -> None:
        self.library.SHA256_Update(ctypes.byref(self.context), data, ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out, end = ctypes.create_string_buffer(32), _Context.from_buffer_copy(self.context)
        self.library.SHA256_Final(out, ctypes.byref(end))
        return out.raw.hex()

    def state(self) -> bytes:
        return bytes(self.context)


def _agrees(library: ctypes.CDLL) -> bool:
    first = Sha256(None, library)
    first.update(b"a" * 100)
    second = Sha256(first.state(), library)
    second.update(b"b" * 100)
    return second.hexdigest() == hashlib.sha256(b"a" * 100 + b"b" * 100).hexdigest()


@cache
def _library() -> ctypes.CDLL | None:
    """The libcrypto that hashlib has loaded, or the system's; None where neither carries a state as hashlib hashes."""
    for name in ("libcrypto.so.3", "libcrypto.so.1.1", ctypes.util.find_library("crypto")):
        try:
            library = ctypes.CDLL(name) if name else None
            if library and _agrees(library):
                return library
        except (OSError, AttributeError):
            continue
    return None


def resumed(state: bytes | None) -> Sha256 | None:
    """A digest that goes on from `state` (from the start without one); None where this machine has no library for it."""
    library = _library()
    return Sha256(state, library) if library else None
