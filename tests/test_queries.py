import subprocess
import sys

import pytest
from compare import rows

from schemaloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, duck, data, name):
    got = catalogue.QUERIES[name](spark, data).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    assert rows(got) == rows(duck.sql(catalogue.ORACLES[name]).df())


def test_entry_works_without_the_training_data_package(data):
    """As if the package and the pipeline had been deleted."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('schemaloom.llm') or name == 'corpus_pipeline': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'rehydrate_events' in e.queries() and not any(k.startswith('op') and k[2].isdigit() for k in e.queries())\n"
        "assert e.oracle_sql().keys() <= e.queries().keys()\n"
    )
    from conftest import ROOT

    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_every_sql_has_its_query():
    import __spark_entry__ as e

    assert e.oracle_sql().keys() <= e.queries().keys()
