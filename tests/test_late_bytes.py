"""The encoding of delimited text whose first letter outside ASCII comes late."""

import pytest

from statloom.sources import tables


@pytest.mark.parametrize(("encoding", "late"), [("utf-8", "yaş\ufffd"), ("windows-1254", "yaş"), ("windows-1254", "şık ğ"), ("iso-8859-1", "caf\u00e9\u0081")])
def test_all_rows_decide_the_encoding(spark, tmp_path, encoding, late):
    path = tmp_path / "late.csv"
    path.write_bytes(("id;name\n" + "1;plain\n" * 20_000 + f"2;{late}\n").encode(encoding))
    found = tables.load_csv(spark, str(path))
    assert found.columns == ["id", "name"] and {r["name"] for r in found.select("name").distinct().collect()} == {"plain", late}
