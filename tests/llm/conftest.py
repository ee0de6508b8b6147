import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def texts():
    """Odd texts: empty, one word, blanks, special tokens, signs beyond ASCII, repeats and one long text."""
    rng = random.Random(4)
    some = ["".join(rng.choice("ab é\n日😀'st thein12.,") for _ in range(rng.randint(0, 80))) for _ in range(150)]
    return [
        None, "", " ", "a", "\n\n\tx", "it's we're I'll   x\n\n y'all 'so !'s 's", "a<|endoftext|>b", " <|endoftext|><|endoftext|> ", "aaaaaaaaaaaaaaaa",
        "日本語 テスト😀😀", "<s> </s><0x41>", "İstanbul ß K", "x" * 5000, "to be " * 400, *some, *some[:20]]


@pytest.fixture(scope="session")
def frame(spark, texts):
    """The odd texts as rows: ids null or repeated here and there, and columns whose names clash with those that operators use."""
    rows = [(None if i % 41 == 40 else i if i % 37 else 3, t, i, "k", b"x", 1.5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id long, k1 string, kept binary, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
