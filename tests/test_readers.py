import json

import pytest

from regionloom.operators import merge
from regionloom.sources import readers


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    return str(path)


def test_files_come_in_the_order_asked_for(spark, tmp_path):
    """Not in that of their sizes; blank lines keep their numbers and fields of any name stay."""
    one = lines(tmp_path / "a b.jsonl", [{"image_path": "x", "heatmap": [[1, 2]], "extra": {"q": 1}}])
    two = lines(tmp_path / "c.jsonl", [{"image_path": "x", "heatmap": [[3, 1]]}, "", *[{"image_path": f"y{i}", "heatmap": [[i, 0]]} for i in range(9)]])
    rows = readers.load_heatmaps(spark, [one, two], extra=True).orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == [0, 1, *range(3, 12)] and rows[0].extra.q == 1
    assert [r.image_path for r in rows] == ["x", "x", *[f"y{i}" for i in range(9)]]
    first = {p: merge.merge_duplicates(readers.load_heatmaps(spark, [one, two]), p).where("image_path = 'x'").first().heatmap for p in ("first", "last", "max")}
    assert first == {"first": [[1, 2]], "last": [[3, 1]], "max": [[3, 2]]}
    assert merge.merge_duplicates(readers.load_heatmaps(spark, [two, one]), "last").where("image_path = 'x'").first().heatmap == [[1, 2]]


@pytest.mark.parametrize(("row", "message"), [("not json", "invalid JSON"), ("[1]", "no object"), ({"heatmap": [[1]]}, "missing image_path"), ({"image_path": "q"}, "missing heatmap"), ({"image_path": "q", "heatmap": "z"}, "wrong type")])
def test_no_line_vanishes(spark, tmp_path, row, message):
    path = lines(tmp_path / "bad.jsonl", [{"image_path": "x", "heatmap": [[1, 2]]}, row])
    with pytest.raises(Exception, match=f"{message}.*bad.jsonl:2"):
        readers.load_heatmaps(spark, path).select("image_path").collect()


def test_empty_cache(spark, tmp_path):
    with pytest.raises(ValueError, match="no heatmaps"):
        readers.load_heatmaps(spark, lines(tmp_path / "e.jsonl", [""]))
