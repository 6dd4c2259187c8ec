"""Rows and rejects together are the lines of the text."""

import pytest

from haulage.sources.rejects import load_checked

SCHEMA = "id long, price double, day date, note string"


def put(tmp_path, name, lines):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")


def test_csv_rows_and_rejects_add_up(spark, tmp_path):
    put(tmp_path, "a.csv", ["id,price,day,note", "1,2.5,2024-01-31,fine", "x,2.5,2024-01-31,no number", "3,,2024-02-30,no day", "4,1,2024-02-01",
                            '5,7,2024-02-01,"a, quoted ""one"""', "6,7,2024-02-01,too,many", "", "7,,,"])
    put(tmp_path, "b.csv", ["id,price,day,note", "8,1e3,2024-03-01,ünï", ",,,,"])
    found = load_checked(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"))
    assert sorted((r.id, r.note) for r in found.rows.collect()) == [(1, "fine"), (5, 'a, quoted "one"'), (7, None), (8, "ünï")]
    assert sorted(r.text for r in found.rejects.collect()) == [",,,,", "3,,2024-02-30,no day", "4,1,2024-02-01", "6,7,2024-02-01,too,many", "x,2.5,2024-01-31,no number"]
    counts = {r.file.rsplit("/", 1)[1]: (r.n_rows, r.n_rejects) for r in found.manifest.collect()}
    assert counts == {"a.csv": (3, 4), "b.csv": (1, 1)}
    assert {r.file.rsplit("/", 1)[1] for r in found.rejects.where("text LIKE ',,%'").collect()} == {"b.csv"}
    assert found.rows.columns == ["id", "price", "day", "note"] and found.rejects.count() == 5


def test_json_lines(spark, tmp_path):
    put(tmp_path, "a.json", ['{"id": 1, "price": 2.0, "day": "2024-01-01", "note": "x"}', '{"id": "one"}', '{"id": 2', '{"id": 3}'])
    found = load_checked(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), kind="json")
    assert sorted(r.id for r in found.rows.collect()) == [1, 3]
    assert sorted(r.text for r in found.rejects.collect()) == ['{"id": "one"}', '{"id": 2']


def test_refused_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        load_checked(spark, str(tmp_path), SCHEMA, str(tmp_path / "out"), kind="xml")
    with pytest.raises(ValueError):
        load_checked(spark, str(tmp_path), "_file string", str(tmp_path / "out"))
