"""Small helpers of the command surface: sizes, memory, alignment and the parsers of option values."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass


def human_bytes(n: int) -> str:
    """1024-based with one decimal."""
    units, value = ("B", "KiB", "MiB", "GiB", "TiB", "PiB"), float(n)
    for unit in units:
        if value < 1024 or unit == units[-1]:
            return f"{n} B" if unit == "B" else f"{value:.1f} {unit}"
        value /= 1024
    raise AssertionError


def parse_kb_field(text: str, field: str) -> int | None:
    """Bytes of a `Field:   123 kB` line, or None."""
    found = re.search(rf"^{re.escape(field)}:\s+(\d+)\s+kB", text, re.M)
    return int(found[1]) * 1024 if found else None


def resident_set_size(status: str = "/proc/self/status") -> tuple[int, int] | None:
    """Current and peak resident bytes of this process, where the system tells."""
    try:
        with open(status) as f:
            text = f.read()
    except OSError:
        return None
    now, peak = parse_kb_field(text, "VmRSS"), parse_kb_field(text, "VmHWM")
    return None if now is None or peak is None else (now, peak)


def align(offset: int, to: int = 8) -> int:
    return math.ceil(offset / to) * to


def layer_bytes(nodes: int, cap: int) -> int:
    """A layer's slots: a degree and cap neighbours of four bytes a node."""
    return nodes * (cap + 1) * 4


@dataclass(frozen=True)
class SyncPolicy:
    """When a log batch is made durable: every record (1), every n records, or never (0)."""

    every: int

    @staticmethod
    def parse(text: str) -> SyncPolicy:
        if text == "always":
            return SyncPolicy(1)
        if text == "never":
            return SyncPolicy(0)
        if (found := re.fullmatch(r"every:(\d+)", text)) and int(found[1]) > 0:
            return SyncPolicy(int(found[1]))
        raise ValueError(f"sync policy must be always, never or every:N, not {text!r}")
