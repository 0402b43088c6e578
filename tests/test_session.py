"""Where results are written down, and who removes them."""

import os

from ledgerline.session import new_path, scratch, write_down


def test_scratch_removes_what_was_written_inside(spark):
    with scratch(spark):
        inside = write_down(spark.range(10))
        files = inside.inputFiles()
        assert inside.count() == 10 and files and all(os.path.exists(f.removeprefix("file://")) for f in files)
        with scratch(spark):
            inner = write_down(spark.range(3)).inputFiles()
        assert not any(os.path.exists(f.removeprefix("file://")) for f in inner) and inside.count() == 10
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_without_a_setting_the_warehouse_is_used(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.sql.warehouse.dir": "file:/shared/warehouse"}.get(key, default)

    class Session:
        conf = Conf()
    assert new_path(Session()).startswith("file:/shared/warehouse/_written/ledgerline-")
