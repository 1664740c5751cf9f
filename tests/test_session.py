"""Tables in the shared folder are deleted when what they are for is done."""

import os
from threading import Thread

import pytest

from fillgap import cli, session
from tests.test_text import NET


def tables(spark):
    return set(os.listdir(session.shared_dir(spark).removeprefix("file://")))


def test_scratch_deletes_what_is_written_inside(spark, tmp_path):
    before = session.cut(spark.range(3))
    there = tables(spark)
    with session.scratch(spark):
        outer = session.cut(spark.range(5))
        with session.scratch(spark):
            session.cut(outer).write.parquet(str(tmp_path / "kept"))
        assert outer.count() == 5 and len(tables(spark)) == len(there) + 1
    assert tables(spark) == there and before.count() == 3
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5


def test_scratch_deletes_after_an_error(spark):
    there = tables(spark)
    with pytest.raises(ValueError), session.scratch(spark):
        session.cut(spark.range(5))
        session.new_path(spark)  # nothing is ever written there
        raise ValueError
    assert tables(spark) == there


def test_scratch_leaves_other_threads_alone(spark):
    made = []
    with session.scratch(spark):
        other = Thread(target=lambda: made.append(session.cut(spark.range(7))))
        other.start()
        other.join()
    assert made[0].count() == 7


def test_a_path_without_the_table_is_no_error_and_clear_takes_the_rest(spark, monkeypatch):
    monkeypatch.setattr(session, "_written", {})  # other tests keep theirs
    there = tables(spark)
    session.delete(spark, [session.new_path(spark)])
    kept = session.cut(spark.range(2))
    assert kept.count() == 2 and len(tables(spark)) == len(there) + 1
    session.clear(spark)
    assert tables(spark) == there


@pytest.mark.parametrize("argv", [["filter", "--kind", "fill"], ["sort", "--records", "reference"], ["stats"]])
def test_commands_leave_no_tables(spark, tmp_path, capsys, argv):
    (tmp_path / "a.net").write_bytes(NET)
    there = tables(spark)
    assert cli.run([argv[0], "--net", str(tmp_path / "a.net"), *argv[1:]], spark) == 0
    assert capsys.readouterr().out and tables(spark) == there
