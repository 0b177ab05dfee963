import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p7_found"} <= set(entry.queries())


def test_nothing_outside_imports_the_subpackage():
    for p in [*ROOT.glob("roadloom/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in p.relative_to(ROOT).parts and p.name != "test_entry.py":
            assert not re.search(r"roadloom\.llm|from roadloom import llm", p.read_text()), p
