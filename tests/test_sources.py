"""Files in and out: inventories, digests, glossaries, nested JSON, artifacts."""

import hashlib
import json

from docspark.sources import pages, tables


def test_inventory_and_digests(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"x" * 10)
    (tmp_path / "b.docx").write_bytes(b"y" * 100)
    (tmp_path / "c.exe").write_bytes(b"z")
    got = {r.path.rsplit("/", 1)[1]: r.accepted for r in tables.file_inventory(spark, str(tmp_path), ["pdf", "docx"], 50).collect()}
    assert got == {"a.PDF": True, "b.docx": False, "c.exe": False}
    index = spark.createDataFrame([("a.PDF", hashlib.sha256(b"x" * 10).hexdigest()), ("b.docx", "0"), ("gone", "1")], "name string, sha256 string")
    assert {(r.name, r.missing) for r in tables.verify_artifacts(spark, str(tmp_path), index).collect()} == {("b.docx", False), ("gone", True)}


def test_glossary(spark, tmp_path):
    (tmp_path / "g.csv").write_text("English,Translation,Comment,DNT\nBatch record,Chargenprotokoll,,no\nGxP,,,ja\n,x,,\nbatch RECORD ,y,,\nlot,,,\npan,Pfanne,,maybe\n", encoding="utf-8")
    entries, problems = tables.read_glossary_csv(spark, str(tmp_path / "g.csv"))
    assert {(r.source_term, r.target_term, r.do_not_translate) for r in entries.collect()} == {("Batch record", "Chargenprotokoll", False), ("GxP", "GxP", True)}
    assert sorted(r.problem for r in problems.collect()) == ["no source term", "no target term", "repeated term", "unclear flag"]
    tables.write_glossary_csv(entries, str(tmp_path / "out"))
    again, bad = tables.read_glossary_csv(spark, str(tmp_path / "out"))
    assert again.count() == 2 and bad.count() == 0
    (tmp_path / "h.csv").write_text("Target\nx\n")
    assert tables.read_glossary_csv(spark, str(tmp_path / "h.csv"))[1].count() == 1


def test_json_and_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, None), (2, 1, "c")], "job long, seq long, text string")
    tables.nest(rows, ["job"], "seq", "units").coalesce(1).write.json(str(tmp_path / "json"))
    lines = [json.loads(x) for p in (tmp_path / "json").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda x: x["job"]) == [{"job": 1, "units": [{"seq": 1}, {"seq": 2, "text": "b"}]}, {"job": 2, "units": [{"seq": 1, "text": "c"}]}]
    good, bad = tables.read_json_strict(spark.createDataFrame([('{"a": 1}',), ("{",), ('{"a": "x"}',), (None,)], "j string"), "j", "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 3
    one = tables.write_artifact(rows, str(tmp_path / "art"), "facts", "all", 1).collect()
    two = tables.write_artifact(rows.repartition(3), str(tmp_path / "art"), "facts", "all", 2).collect()
    assert one[0].n == 3 and one[0].sha256 == two[0].sha256 and spark.read.parquet(str(tmp_path / "art")).count() == 6


def test_html_blocks(spark):
    df = spark.createDataFrame([(1, "<title>A &amp; B</title><h1 class='x'><b>Top &lt;1&gt;</b></h1><p>one<p>two <i>x</i><ul><li>i1</li></ul>"), (2, None), (3, "")], "page_id long, html string")
    got = [(r.doc_id, r.seq, r.kind, r.text) for r in pages.html_blocks(df).collect()]
    assert got == [(1, 1, "title", "A & B"), (1, 2, "heading", "Top <1>"), (1, 3, "paragraph", "one"), (1, 4, "paragraph", "two"), (1, 5, "list_item", "i1")]
