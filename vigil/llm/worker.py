"""One costly object per Python worker process.

A worker serves tasks of many queries and stages. What it keeps between tasks (an encoder with its cache, word hashes, voters) is worth
having while tasks of one kind follow each other; when another kind comes, the former object goes, so that
memory stays bounded by the largest of them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import Any

import pyarrow as pa

_KEPT: dict[Hashable, Any] = {}


def keep(key: Hashable, make: Callable[[], Any]) -> Any:
    if key not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # freed memory goes back to the system
                trim(0)
        _KEPT[key] = make()
    return _KEPT[key]
