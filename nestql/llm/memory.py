"""Python workers live on between tasks and operators: what a task held goes back to the system when it ends.

What modules keep between tasks (tables of powers, tokenizers with their pieces) stays as long as tasks of one operator follow each
other; the first task of another operator lets go of it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import Any

import pyarrow as pa

_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1
_libc: Any = None
_forget: list[Callable[[], None]] = []
_last = ""


def _system() -> Any:
    """The C library, told once to give large blocks back at once; False if it isn't one that can."""
    global _libc
    if _libc is None:
        try:
            _libc = ctypes.CDLL(None)
            _libc.mallopt(_MMAP_THRESHOLD, 1 << 20)
            _libc.mallopt(_TRIM_THRESHOLD, 1 << 22)
            _libc.malloc_trim(0)
            pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pool holds on to more than it uses
        except (OSError, AttributeError):
            _libc = False
    return _libc


def keeps(forget: Callable[[], None]) -> None:
    """For a module that keeps something between tasks: how to let go of it."""
    _forget.append(forget)


def _begin(operator: str) -> None:
    global _last
    _system()
    if operator != _last:
        for forget in _forget:
            forget()
        release()
        _last = operator


def release() -> None:
    pa.default_memory_pool().release_unused()
    if libc := _system():
        libc.malloc_trim(0)


def tidy(run: Callable[..., Any]) -> Callable[..., Any]:
    """For a function of batches or of the table of a group: release memory after it."""

    @wraps(run)
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(run.__module__)
        yield from run(it)
        release()

    return batches


def tidy_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a function of the tables of a group or a pair of groups."""
    if run.__code__.co_argcount == 2:  # Spark looks at the number of arguments

        def group(a: pa.Table, b: pa.Table) -> pa.Table:
            _begin(run.__module__)
            out = run(a, b)
            release()
            return out

    else:

        def group(a: pa.Table) -> pa.Table:
            _begin(run.__module__)
            out = run(a)
            release()
            return out

    return group
