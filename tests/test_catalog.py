import importlib

from octetloom.catalog import OPERATIONS, missing


def test_what_is_named_exists():
    assert len(OPERATIONS) == 78
    for functions in OPERATIONS.values():
        for f in functions:
            module, name = f.rsplit(".", 1)
            assert callable(getattr(importlib.import_module(module), name)), f
    assert "source.survey" not in missing()
