"""The driver's contract where the corpus part, or a package it needs, is absent."""

import os
import subprocess
import sys

import pytest

from tallyshop import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
import sys, warnings
sys.modules[{absent!r}] = None
with warnings.catch_warnings(record=True) as seen:
    warnings.simplefilter("always")
    import __spark_entry__ as contract
assert any("no corpus queries" in str(w.message) for w in seen)
assert sorted(contract.queries()) == sorted(contract.oracle_sql())
print(len(contract.queries()))
"""


@pytest.mark.parametrize("absent", ["ahocorasick", "tallyshop.llm", "corpus_pipeline"])
def test_reports_do_not_need_the_corpus_part(absent):
    ran = subprocess.run(
        [sys.executable, "-c", PROGRAM.format(absent=absent)],
        cwd=ROOT, capture_output=True, text=True, check=True,
    )
    assert int(ran.stdout) == len(catalogue.queries())


def test_without_the_corpus_part_its_packages_do_not_matter():
    # nothing outside the corpus part imports it
    for folder, _, files in os.walk(os.path.join(ROOT, "tallyshop")):
        if os.path.basename(folder) == "llm":
            continue
        for file in files:
            if file.endswith(".py"):
                with open(os.path.join(folder, file)) as source:
                    assert "tallyshop.llm" not in source.read()
