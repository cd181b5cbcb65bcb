import importlib

import pytest

from tagloom import llm
from tests.conftest import SF, check_against_sql

MODULES = [importlib.import_module(m) for m in llm.QUERY_MODULES]
CASES = [(n, m) for m in MODULES for n in m.QUERIES]


@pytest.mark.parametrize("name,module", CASES, ids=[c[0] for c in CASES])
def test_query(spark, duck, name, module):
    if name in module.ORACLES:
        check_against_sql(spark, duck, module.QUERIES[name], module.ORACLES[name])
    else:
        rows = module.QUERIES[name](spark, SF).collect()
        assert len(set(rows)) == len(rows)
