import re
import subprocess
import sys
from pathlib import Path

import dayloom.llm.common as c

ROOT = Path(c.__file__).parents[2]

#: 200 MB in blocks that the C library takes from its heap, freed but for the last, which pins the heap's end.
TASK = """
import sys
import psutil
import numpy as np
from dayloom.llm.common import lean
pins = []

def run(batches):
    blocks = [np.ones(100_000, np.uint8) for _ in range(2000)]
    pins.append(blocks[-1])
    yield from batches

rss = psutil.Process().memory_info
before = rss().rss
assert list((lean(run) if sys.argv[1] == "lean" else run)([1, 2])) == [1, 2]
print((rss().rss - before) // 1_000_000)
"""


def test_a_worker_gives_back_what_a_task_has_freed():
    left = {k: int(subprocess.run([sys.executable, "-c", TASK, k], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()[-1]) for k in ("lean", "plain")}
    assert left["plain"] > 150 and left["lean"] < 40


def test_every_function_of_the_pipeline_gives_its_memory_back():
    for name in ("common", "quality", "ngram_join", "pii", "mixing", "pieces"):
        assert set(re.findall(r"\.mapInArrow\((\w+)", (ROOT / f"dayloom/llm/{name}.py").read_text())) <= {"lean"}


def test_lean_passes_an_error_on():
    def run(batches):
        yield from batches
        raise ValueError("x")

    seen = []
    try:
        seen.extend(c.lean(run)(iter([1])))
    except ValueError as e:
        seen.append(str(e))
    assert seen in ([1, "x"], ["x"])
