"""Sizes and schedules: how a run is cut into blocks, groups and tree levels."""

from __future__ import annotations

MB = 1 << 20


def check_sub_rows(sub_rows: int | None, columns: int, split_mb: int = 64) -> int:
    """Rows of a block: at least the number of columns, halved while a block is larger than a split."""
    sub_rows = columns if sub_rows is None else sub_rows
    if columns < 1:
        raise ValueError("a matrix needs a column")
    if sub_rows < columns:
        raise ValueError(f"sub_rows {sub_rows} is less than the number of columns {columns}")
    while sub_rows * columns * 8 >= split_mb * MB and sub_rows // 2 >= columns:
        sub_rows //= 2
    return sub_rows


def check_split(split_mb: int, total_bytes: int, task_memory_mb: int, slots: int) -> int:
    """The split size, doubled until the tasks of one wave fit the memory of all slots."""
    while split_mb * slots <= task_memory_mb and total_bytes > split_mb * MB * slots * slots:
        split_mb *= 2
    return split_mb


def map_tasks(total_bytes: int, split_mb: int) -> int:
    return total_bytes // (split_mb * MB) + 1


def parse_schedule(schedule: str | list[int] | None) -> list[int] | None:
    """Groups of each tree level; the last is 1. None leaves the choice to schedule_for."""
    if schedule is None:
        return None
    levels = [int(x) for x in schedule.split(",")] if isinstance(schedule, str) else [int(x) for x in schedule]
    if not levels or levels[-1] != 1 or min(levels) < 1:
        raise ValueError(f"a schedule is a list of positive numbers that ends with 1, not {schedule!r}")
    return levels


def schedule_for(factors: int, columns: int, split_mb: int = 64) -> list[int]:
    """Levels such that no task stacks more factors than fit in a split (64 at the most, 2 at least)."""
    fan_in = max(2, min(64, split_mb * MB // (8 * columns * columns)))
    levels = []
    while factors > fan_in:
        factors = -(-factors // fan_in)
        levels.append(factors)
    return [*levels, 1] if not levels or levels[-1] != 1 else levels


def group_rows(columns: int, payload: int, split_mb: int = 64) -> int:
    """Rows that one local factorisation stacks: what fits in a split, at least the number of columns."""
    return max(columns, split_mb * MB // (8 * (columns + payload)))
