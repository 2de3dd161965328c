"""What a worker keeps between tasks; each case in a process of its own, with an untouched heap."""

import subprocess
import sys
from pathlib import Path

START = """
import random, re
import numpy as np, public_tokenizers, pyarrow as pa
from gristmill.llm import bpe, common

def used():
    return int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024
"""


def left(code: str) -> list[int]:
    """The MB that the code prints."""
    out = subprocess.run([sys.executable, "-c", START + code], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True, timeout=300)
    return [int(x) for x in out.stdout.split()]


def test_release_returns_memory_to_the_system():
    held, after = left("""
before = used()
parts = [np.ones(1 << 16, np.uint8) for _ in range(3000)]
pin = np.ones(1 << 16, np.uint8)  # what stands last keeps the heap from shrinking by itself
print(used() - before)
parts.clear()
common.release()
print(used() - before)
""")
    assert held > 150 and after < 40


def test_bpe_keeps_little_between_batches():
    """Six batches of 12 MB, of words that are known after the first."""
    encoder, most = left("""
rnd = random.Random(1)
words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]
texts = pa.array([" ".join(rnd.choices(words, k=500)) for _ in range(4000)], pa.string())
batch = pa.record_batch([pa.array(range(4000), pa.int64()), texts], ["doc_id", "text"])
before, after = used(), []
bpe.encoder(path := public_tokenizers.path(bpe.VOCABULARY))
print(used() - before)

def batches():
    for _ in range(6):
        yield pa.record_batch([batch.column(0), pa.array(batch.column(1).to_pylist(), pa.string())], ["doc_id", "text"])
        after.append(used() - before)

assert sum(b.num_rows for b in bpe.digests(path)(batches())) == 24_000
print(max(after))
""")
    assert most < encoder + 40
