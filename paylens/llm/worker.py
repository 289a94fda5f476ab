"""Tables that a Python worker keeps between tasks, and when it lets go of them.

Workers serve one operator after another. What one has kept is only in the way of the next, so
each says whose turn it is; a change of turn drops everything that the others have kept, and
gives the pages back to the system: freed memory stays with the process otherwise.
"""

from __future__ import annotations

import ctypes
import gc
from typing import Any

import pyarrow as pa

_KEPT: dict[tuple, Any] = {}
_TURN = ""


def give_back() -> None:
    """Returns free pages of Arrow's pool and of the allocator, where it can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def turn(owner: str) -> None:
    """It is ``owner``'s turn in this worker; called when a task starts."""
    global _TURN
    if _TURN != owner:
        _TURN = owner
        for key in [k for k in _KEPT if k[0] != owner]:
            del _KEPT[key]
        give_back()


def kept(owner: str, key: tuple, make):
    """What ``make`` gave for ``key`` when it was first asked for in this turn."""
    turn(owner)
    if (owner, *key) not in _KEPT:
        _KEPT[owner, *key] = make()
    return _KEPT[owner, *key]
