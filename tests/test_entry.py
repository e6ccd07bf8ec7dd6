import sys
import warnings

import pytest


@pytest.mark.parametrize("said", ["No module named 'lumenpass.llm'", "No module named 'xxhash'", "numpy is too old"])
def test_rest_works_without_optional_parts(monkeypatch, said):
    import importlib

    import __spark_entry__ as e

    real = importlib.import_module

    def broken(name, *a):
        if name.startswith(("lumenpass.llm", "corpus_pipeline")):
            missing = said.split("'")[1] if "'" in said else None
            raise ModuleNotFoundError(said, name=missing) if missing else ImportError(said)
        return real(name, *a)

    monkeypatch.setattr(importlib, "import_module", broken)
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        found = e.queries()
        assert "hybrid_rrf" in found and "build_index" in e.oracle_sql() and not any(n.startswith("op") and n[2].isdigit() for n in found) and "pipeline" not in found
    assert bool(told) == ("lumenpass" not in said)
    assert "lumenpass.plans.queries" in sys.modules


def test_no_machine_local_folder_on_a_cluster():
    from lumenpass.sources import work

    class Fake:
        def __init__(self, master, folder=None):
            self.sparkContext = type("C", (), {"master": master, "applicationId": "x", "setCheckpointDir": staticmethod(lambda f: None)})
            self.conf = type("D", (), {"get": staticmethod(lambda k, d: folder or d)})

    with pytest.raises(ValueError):
        work.shared_folder(Fake("spark://somewhere:7077"))
    with pytest.raises(ValueError):
        work.shared_folder(Fake("local-cluster[3,2,1000]"))
    assert work.shared_folder(Fake("yarn", "s3a://b/x/")) == "s3a://b/x"
    assert work.shared_folder(Fake("local[4]")).startswith("file://")
