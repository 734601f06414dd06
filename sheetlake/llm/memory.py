"""Giving freed memory back between the tasks of a Python worker."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def release() -> None:
    """Return what the allocators keep for later; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
