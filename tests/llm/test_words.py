from pathlib import Path

import numpy as np

from lacuna.llm import words


def _resident():
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_a_task_gives_free_memory_back():
    """Also what lies between blocks that stay in use."""
    blocks = [np.ones(200, np.int64) for _ in range(60_000)]
    kept = blocks[::50]
    before = _resident()

    def run(batches):
        blocks.clear()
        yield from batches

    assert list(words.tidied(run)(iter([]))) == []
    assert _resident() < before - 60_000_000
    assert len(kept) == 1200
