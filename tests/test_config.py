import pytest

from millrace.plans.config import Destination, Settings


def test_settings():
    got = Settings.of({"replication": {"name": "r", "settings": {"cache": 5}}, "destination": {"destinations": {"a": {"sync": {"replicate": {"do_db": "x, y ,", "ignore_tab": ["x.t"]}, "merge_commit": {"max_count": 0}, "dml_mode": {"insert": "replace"}}}, "b": None}}})
    assert (got.name, got.files_at_once, set(got.destinations)) == ("r", 1000, {"a", "b"})
    a = got.destinations["a"]
    assert (a.rule.do_db, a.rule.ignore_table, a.max_count, a.insert, a.update) == (("x", "y"), ("x.t",), 1, "replace", "update")
    with pytest.raises(ValueError):
        Destination.of("c", {"sync": {"dml_mode": {"update": "merge"}}})
