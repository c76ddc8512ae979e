"""What the corpus queries need where they run."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

AWAY = f"""
import sys
sys.path.insert(0, {ROOT!r})  # the driver's alone: workers start in another folder and have not this path
from tidemark.runtime import local_session
from tidemark.llm import queries
spark = local_session(2)

def sees_package(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("tidemark") is not None])], names=["sees"])

assert not spark.range(1).mapInArrow(sees_package, "sees boolean").first()[0]
for name in ("op1_lm_scoring", "op3_chat", "op10_decontamination", "op11_ranked", "op12_importance"):
    print(name, queries.QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""

HIDDEN = f"""
import sys
sys.path.insert(0, {ROOT!r})
sys.modules["xxhash"] = None  # importing it now fails as if it were not installed
import __spark_entry__ as entry
print(len(entry.queries()), sum(n.startswith("op") for n in entry.queries()))
"""


def run(code, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout.splitlines()


def test_executors_need_no_package(tmp_path):
    counts = dict(line.split() for line in run(AWAY, tmp_path) if line.startswith("op"))
    assert len(counts) == 5 and all(int(n) > 0 for n in counts.values())


def test_the_rest_works_without_a_library_of_the_corpus_queries(tmp_path):
    every, corpus = map(int, run(HIDDEN, tmp_path)[-1].split())
    assert every > 70 and corpus == 0
