import __spark_entry__ as E


def test_all_are_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(E.oracle_sql()) <= set(names)
