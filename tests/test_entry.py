import __spark_entry__ as entry


def test_entry_and_names(spark, sf):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert {"p3_found", "p5_found"} <= set(names)


def test_core_stands_alone():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "legistra"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"legistra\.llm|from \.+llm", f.read_text()), f
