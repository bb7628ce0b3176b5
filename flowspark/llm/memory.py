"""Memories of Python workers, which outlive a task: one operator's are dropped when another's tasks begin."""

_every: list[dict] = []


def remembered(memory: dict) -> dict:
    """Register a module's memory."""
    _every.append(memory)
    return memory


def alone(memory: dict) -> None:
    """Empty all registered memories but this one."""
    for other in _every:
        if other is not memory:
            other.clear()
