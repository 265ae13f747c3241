"""Limits on what one document may take: memory of the process, and progress of a reader."""

from __future__ import annotations

import logging
import os

log = logging.getLogger("tessera.codec")
#: Shares of the memory at which a warning is logged, and at which the work ends.
WARN, ABORT = (0.5, 0.75, 0.9), 0.95


def memory_limit() -> int | None:
    """Bytes that this process may use: the least of its control group's and the machine's; None if unknown."""
    found = []
    for path in ("/sys/fs/cgroup/memory.max", "/sys/fs/cgroup/memory/memory.limit_in_bytes"):
        try:
            with open(path) as f:
                found.append(int(f.read()))
        except (OSError, ValueError):
            pass
    try:
        found.append(os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES"))
    except (OSError, ValueError):
        pass
    return min(found) if found else None


def memory_used() -> int | None:
    """Bytes of this process that are resident."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError):
        return None


class MemoryGuard:
    """Looks at the memory after every ``every`` entries; warns once a threshold, and raises MemoryError past the last."""

    def __init__(self, every: int = 65_536, limit: int | None = None, used=memory_used):
        self.every, self.limit, self.used = every, limit if limit is not None else memory_limit(), used
        self.entries, self.warned = 0, 0

    def added(self, n: int = 1) -> None:
        before, self.entries = self.entries, self.entries + n
        if self.entries // self.every > before // self.every:
            self.check()

    def check(self) -> None:
        used = self.used()
        if not self.limit or used is None:
            return
        share = used / self.limit
        if share >= ABORT:
            raise MemoryError(f"{share:.0%} of the memory is used")
        while self.warned < len(WARN) and share >= WARN[self.warned]:
            log.warning("%.0f %% of the memory is used", 100 * share)
            self.warned += 1


class StallGuard:
    """Raises ValueError after ``most`` steps that neither read a bit nor changed the depth."""

    def __init__(self, most: int = 32):
        self.most, self.last, self.still = most, None, 0

    def step(self, *state) -> None:
        self.still = self.still + 1 if state == self.last else 0
        self.last = state
        if self.still > self.most:
            raise ValueError("the stream gives events without an end")
