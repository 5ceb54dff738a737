"""What operators send to tasks opens where this package is not installed."""

import os
import subprocess
import sys

import numpy as np
import pytest

from billmill.llm import attention_lm, decontaminate, language
from billmill.llm.common import Shared

OPEN = "import pickle, sys; print(type(pickle.load(open(sys.argv[1], 'rb'))).__name__)"




@pytest.mark.parametrize(
    "value",
    [
        language.Model(["en"], np.zeros(1, np.int64), np.zeros((1, 1)), np.zeros((1, 1))),
        attention_lm.Attention.new(),
        decontaminate.Index([], None),
    ],
    ids=lambda v: type(v).__name__,
)
def test_values_carry_their_classes(spark, tmp_path, value):
    shared = Shared(spark, value)
    assert type(shared.value).__name__ == type(value).__name__
    (tmp_path / "value").write_bytes(shared.packed.value)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", OPEN, str(tmp_path / "value")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60)
    assert run.stdout.strip() == type(value).__name__, run.stderr


def test_shared_values_travel_in_closures(spark):
    shared = Shared(spark, {"a": 1})
    got = spark.range(3).mapInArrow(lambda batches: (b for b in batches if shared.value["a"] == 1), "id long").count()
    assert got == 3
