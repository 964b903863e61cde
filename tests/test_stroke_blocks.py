"""Blocks of a pen file are bounded however large the split that holds them."""

from __future__ import annotations

from glyphloom.sources import strokes


def test_blocks_inside_a_split_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(strokes, "BLOCK_LINES", 50)
    text = "".join(f"WORD {'ABC'[k % 3]} s_{k}\nNUMSTROKES {k % 4}\nPOINTS 1 # {k} 4\nPOINTS 1 # 5 6\n" for k in range(150))
    (tmp_path / "pen.txt").write_text(text)
    read = strokes.read_stroke_lines(spark, str(tmp_path)).cache()
    sizes = [r["count"] for r in read.groupBy("block").count().collect()]
    assert max(sizes) <= 50 and sum(sizes) == 600
    got = sorted((r.line, r.label, r.session, r.strokes) for r in strokes.parse_stroke_lines(read).collect())
    whole = spark.createDataFrame([("pen.txt", text.rstrip("\n"))], "path string, value string")
    assert got == sorted((r.line, r.label, r.session, r.strokes) for r in strokes.parse_strokes(whole).collect()) and len(got) > 50
