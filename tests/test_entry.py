"""The entry point with and without its optional parts."""

import importlib
import sys

import pytest

import __spark_entry__
from verbamatch.plans import catalogue


@pytest.fixture
def again():
    """Import the entry anew without these modules."""
    blocked = []

    def load(*names):
        for name in [n for n in sys.modules if n.partition(".")[0] in names or n.startswith(("verbamatch.llm", "corpus_pipeline"))]:
            blocked.append((name, sys.modules.pop(name)))
        for name in names:
            sys.modules[name] = None
        return importlib.reload(__spark_entry__)

    yield load
    for name in [n for n in sys.modules if sys.modules[n] is None]:
        del sys.modules[name]
    sys.modules.update(dict(blocked))
    importlib.reload(__spark_entry__)


@pytest.mark.parametrize("missing", ["ahocorasick", "tiktoken", "verbamatch.llm"])
def test_the_rest_stands_without_optional_parts(again, missing):
    left = again(missing)
    assert set(left.queries()) == set(catalogue.queries()) and set(left.oracle_sql()) == set(catalogue.oracle_sql())


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
