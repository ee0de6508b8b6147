"""Memory of the Python workers, in a session of its own."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
ASK = """
import json, psutil, sys
import numpy as np
from pathlib import Path
from rollbook.llm.quality import FEATURES, WORDS, Classifier, classify, fit_labels
from rollbook.session import local_session

def workers():
    every = [p for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline())]
    said = [dict(line.split(":", 1) for line in Path(f"/proc/{p.pid}/status").read_text().splitlines()) for p in every]
    return [max(int(s[k].split()[0]) // 1024 for s in said) for k in ("RssAnon", "VmHWM")]

spark = local_session(1, shuffle_partitions=1)
spark.sparkContext.setLogLevel("ERROR")
texts = spark.range(0, int(sys.argv[1]), 1, 1).selectExpr("id as doc_id", sys.argv[2] + " as text")
out = classify(texts, Classifier(fit_labels(np.zeros((0, 17), int), np.zeros(0)), np.zeros(FEATURES + WORDS), 0.0), keep=("text",))
out.write.format("noop").mode("overwrite").save()
print(json.dumps(workers()))
"""


LONG = "concat_ws(' ', transform(sequence(1, 600), x -> conv(cast(xxhash64(id, x) & 16777215 as string), 10, 36)))"


@pytest.mark.parametrize(("rows", "text"), [(20_000, "concat('a b ', id)"), (8_000, LONG)], ids=["short texts", "long texts"])
def test_workers_give_memory_back(rows, text):
    """A worker that waits holds little of what its task took, and very short texts take no more than others."""
    ran = subprocess.run([sys.executable, "-c", ASK, str(rows), text], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr
    held, most = json.loads(ran.stdout.splitlines()[-1])
    assert held < 80 and most < 250, (held, most)
