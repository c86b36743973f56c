"""Files, segments and cleaning."""

from pyspark.sql import functions as F

from lexarium.operators import cleaning as C
from lexarium.sources import files


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("первый *** второй кусок", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("текст".encode("cp1251"))
    both = {r["name"]: r["text"] for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert both["b.txt"] == "текст" and both["a.txt"].startswith("первый")
    assert [r["name"] for r in files.read_texts(spark, str(tmp_path), fallback=False).collect()] == ["a.txt"]
    parts = files.split_segments(files.from_rows(spark, [("x", "а б ***  *** в г д")]), least_words=2).collect()
    assert [(r["name"], r["text"]) for r in parts] == [("Segment 1", "а б"), ("Segment 2", "в г д")]


def test_cleaning(spark):
    df = spark.createDataFrame([("„Да“ М<артынов> <– > <...> <я>",)], "text string")
    assert df.select(C.fix_ocr(F.col("text"))).first()[0] == '"Да“ Мартынов – [...] я'
    lines = C.number_lines(spark.createDataFrame([("f", "стих\n12\n(нем.)\nконец (франц.)\nПечатается по автографу\nещё\n\nдальше")], "name string, text string"))
    assert [r["text"] for r in C.remove_footnotes(lines).orderBy("line").collect()] == ["стих", "конец", "Печатается по автографу", "ещё", "", "дальше"]
    assert [r["text"] for r in C.remove_editor_notes(lines).orderBy("line").collect()] == ["стих", "12", "(нем.)", "конец (франц.)", "", "дальше"]
