import os

import pytest
from pyspark.sql import functions as F

from quillveil.backends import check_pipeline, instance
from quillveil.sinks import files
from quillveil.sinks.files import write_output, write_text
from quillveil.sources.mail import decode_mail, html_text, list_files, read_mail_dir
from quillveil.sources.tabular import get_input, read_csv
from quillveil.streaming.masking import masked_stream, start

PLAIN = b"From: a@b.de\nSubject: Hallo\nDate: Wed, 17 Apr 2024 17:13:56 +0200\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=x\n\n--x\nContent-Type: text/plain; charset=latin-1\nContent-Transfer-Encoding: quoted-printable\n\nGr=FC=DFe\n--x\nContent-Type: image/jpeg\nContent-Disposition: attachment; filename=a.JPG\n\nx\n--x\nContent-Type: image/jpeg\nContent-Disposition: attachment; filename=noext\n\nx\n--x--\n"
PAGE = b"Subject: P\nMIME-Version: 1.0\nContent-Type: multipart/alternative; boundary=x\n\n--x\nContent-Type: text/plain\n\n\n--x\nContent-Type: text/html\n\n<html><title>T</title><script>no</script><p>Hi &amp; bye</p></html>\n--x--\n"


def test_decode():
    content, sent, n, kinds, subject = decode_mail(PLAIN)
    assert (content.strip(), n, kinds, subject) == ("Grüße", 2, ["jpg"], "Hallo") and sent.isoformat() == "2024-04-17T17:13:56+02:00"
    content, sent, n, kinds, _ = decode_mail(PAGE)
    assert content.strip() == "THi & bye" and sent is None and n == 0
    assert decode_mail(b"no headers at all")[1:] == (None, 0, [], None)
    assert html_text("1 < 2") == "1 < 2" and html_text(None) is None and html_text("<b>x</b>&lt;") == "x<"


def test_mail_dir(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.eml").write_bytes(PLAIN)
    (tmp_path / "sub" / "b.html").write_bytes(b"<p>page</p>")
    (tmp_path / "c.txt").write_text("no")
    rows = {r.file_name: r for r in read_mail_dir(spark, str(tmp_path), init_data_fields=["extra"]).collect()}
    assert set(rows) == {"a.eml", "b.html"} and rows["a.eml"].attachment == 2 and str(rows["a.eml"].date) == "2024-04-17 15:13:56" and rows["a.eml"].extra is None
    with pytest.raises(OSError):
        list_files(str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        list_files(str(tmp_path), [".zip"])


def test_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('message,n,other\n"a\nb ""q""",1.0,z\n,2,\n')
    rows = read_csv(spark, str(path), ["message", "gone", "n", "lost"], ["content", "date"]).collect()
    assert rows[0].asDict() == {"content": 'a\nb "q"', "date": "unmatched", "n": "1.0"} and rows[1].content is None
    assert get_input(spark, str(path), "csv", ["message"], ["content", "date"]).first().date is None
    (tmp_path / "empty.csv").write_text("")
    assert read_csv(spark, str(tmp_path / "empty.csv"), ["a"]).count() == 0
    with pytest.raises(ValueError):
        read_csv(spark, str(path), [])
    with pytest.raises(OSError):
        read_csv(spark, str(tmp_path / "no.csv"), ["a"])


def test_sinks(spark, tmp_path):
    df = spark.range(2).select(F.col("id"), F.array(F.lit("jpg"), F.lit("png")).alias("attachment type"), F.lit("a <b>").alias("content"), F.create_map(F.lit("k"), F.lit(1)).alias("m"))
    write_output(df, str(tmp_path / "o.csv"), single_file=True)
    text = (tmp_path / "o.csv").read_text()
    assert "['jpg', 'png']" in text and os.path.isfile(tmp_path / "o.csv")
    with pytest.raises(ValueError):
        write_output(df, str(tmp_path / "o.csv"))
    write_output(df, str(tmp_path / "o.csv"), overwrite=True, single_file=True)
    write_output(df, str(tmp_path / "o.xml"), single_file=True)
    xml = (tmp_path / "o.xml").read_text()
    assert "<email_list>" in xml and '<item type="str">png</item>' in xml and '<attachment_type type="list">' in xml
    again = spark.read.format("xml").option("rowTag", "email").load(str(tmp_path / "o.xml"))
    assert {r.content._VALUE for r in again.collect()} == {"a <b>"}
    for bad in ("", str(tmp_path / "o.json")):
        with pytest.raises(ValueError):
            write_output(df, bad)
    with pytest.raises(ValueError):
        write_output(df.limit(0), str(tmp_path / "e.csv"))
    with pytest.raises(ValueError):
        write_text("", str(tmp_path / "t"))


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a@b.de 12",)], "t string").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("t string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        start(masked_stream(source, "t"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.masked for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["[email] [number]"]


def test_backends():
    with pytest.raises(ValueError):
        check_pipeline("x", None)
    with pytest.raises(TypeError):
        check_pipeline("ner", "x")
    with pytest.raises(KeyError):
        check_pipeline("ner", {"task": "t"})
    with pytest.raises(ValueError):
        instance("nothing")
    with pytest.raises(RuntimeError):
        instance("spacy", lang="fr")


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "mask_pipeline" in entry.queries()


def test_maps_in_xml(spark, tmp_path):
    df = spark.sql("select 1 as k, map('content', array('a', 'b'), 'subject', cast(null as array<string>)) as found, map('content', 'fr') as lang")
    files.write_xml(df, f"{tmp_path}/x.xml")
    text = "".join(p.read_text() for p in sorted((tmp_path / "x.xml").glob("part-*")))
    assert '<lang type="dict">' in text and '<key name="content">' in text and '<value type="str">fr</value>' in text and text.count('<item type="str">') == 2


def test_white_space_and_line_ends_survive_csv(spark, tmp_path):
    texts = ["  two \r\nlines \n", 'a "quote", comma', "\ttab", "back\\slash\\", "x"]
    files.write_csv(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string"), f"{tmp_path}/c.csv")
    back = read_csv(spark, f"{tmp_path}/c.csv", ["t", "k"], ["content"])
    assert [r.content for r in sorted(back.collect(), key=lambda r: int(r.k))] == texts
