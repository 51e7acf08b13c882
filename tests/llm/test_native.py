"""The native operators run no Python on the executors and join no side without an equality."""

import contextlib
import io
import os

import pytest

from tarnforge.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", ["op2_hilbert_shards", "op3_url_rules", "op7_chat_format"])
def test_native(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        registry.queries()[name](spark, FOLDER).explain("formatted")
    assert not any(x in out.getvalue() for x in ("Python", "Pandas", "ArrowEval", "MapInArrow", "Cartesian", "NestedLoop"))
