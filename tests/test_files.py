"""Folders of media files as data sources."""

from __future__ import annotations

import io
import zipfile

import pytest

from chronoweft.sources import files, readers, sinks

#: Names, texts and cues of files that other tools write.
FOREIGN = [
    ("hourless", "WEBVTT\n\n00:01.000 --> 00:02.500\nShort\n\n01:03.250 --> 01:04.000\nLater\n", [(1.0, 2.5, "Short"), (63.25, 64.0, "Later")]),
    ("fraction", "1\n00:00:01.5 --> 00:00:02.25\nhalf\n", [(1.5, 2.25, "half")]),
    ("dense", "1\n00:00:01,000 --> 00:00:02,000\nA\n2\n00:00:02,000 --> 00:00:03,000\nB\n", [(1.0, 2.0, "A"), (2.0, 3.0, "B")]),
    ("tags", "WEBVTT\n\n00:00:03.000 --> 00:00:04.000 align:start position:10%\n<v Bob>Tagged</v> <b>bold</b> <i>it</i> <00:00:03.500>x {\\an8}y\n", [(3.0, 4.0, "Tagged bold it x y")]),
    ("bom", "﻿1\r\n00:00:01,000 --> 00:00:02,500\r\nHello there\r\nsecond line\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\n50\r\n\r\n3\r\n01:02:03,456 --> 01:02:05,000\r\nनमस्ते दोस्तों\r\n", [(1.0, 2.5, "Hello there\nsecond line"), (3.0, 4.0, "50"), (3723.456, 3725.0, "नमस्ते दोस्तों")]),
    ("bare", "00:00:01,000 --> 00:00:02,000\nNo index\n\n00:00:03,000 --> 00:00:04,000\nStill none\n", [(1.0, 2.0, "No index"), (3.0, 4.0, "Still none")]),
    ("empty cue", "1\n00:01 --> 00:02\n\n\n2\n00:03 --> 00:04\n\n  late\n\nlost\n", [(3.0, 4.0, "late")]),
    ("nothing", "", []),
    ("no timing", "no timing here\n12\n", []),
]


@pytest.mark.parametrize(("name", "text", "want"), FOREIGN)
def test_subtitle_dialects(spark, name, text, want):
    assert [r[1:] for r in files.subtitle_rows(text)] == want
    got = readers.subtitles(spark.createDataFrame([(name, text)], "rec_id string, value string")).orderBy("i").collect()
    assert [(r["start"], r["end"], r["text"]) for r in got] == want


def test_folder_of_subtitles(spark, tmp_path):
    files.register(spark)
    for k, (name, text, _) in enumerate(FOREIGN):
        folder = tmp_path / ("deep" if k % 2 else "flat")
        folder.mkdir(exist_ok=True)
        (folder / f"{name}.{'vtt' if text.startswith('WEBVTT') else 'SRT'}").write_text(text, encoding="utf-8", newline="")
    (tmp_path / "flat" / "bytes.srt").write_bytes(b"1\n00:01 --> 00:02\n\xff ok\n")
    (tmp_path / "_hidden.srt").write_text(FOREIGN[0][1])
    (tmp_path / "other.log").write_text(FOREIGN[0][1])
    for most in (1, 1 << 30):
        df = spark.read.format("chronoweft_subtitles").option("bytesPerTask", most).load(str(tmp_path))
        assert df.rdd.getNumPartitions() == (len(FOREIGN) + 1 if most == 1 else 1)
        got = {}
        for r in df.orderBy("rec_id", "i").collect():
            got.setdefault(r["rec_id"], []).append((r["start"], r["end"], r["text"]))
        want = {f"{'deep' if k % 2 else 'flat'}/{name}": cues for k, (name, _, cues) in enumerate(FOREIGN) if cues}
        assert got == want | {"flat/bytes": [(1.0, 2.0, "� ok")]}
    one = spark.read.format("chronoweft_subtitles").load(f"file://{tmp_path}/flat/hourless.vtt")
    assert {r["rec_id"] for r in one.collect()} == {"hourless"}
    assert spark.read.format("chronoweft_turns").load(str(tmp_path / "deep")).count() == 0


def test_written_files_read_back(spark, tmp_path):
    files.register(spark)
    cues = spark.createDataFrame([(rec, k, k * 1.5, k * 1.5 + 1, f"{rec} {k}") for rec in ("a/b", "_x", ".y", "plain", "é") for k in range(3)], "rec_id string, i long, start double, end double, text string")
    path = str(tmp_path / "out")
    sinks.to_srt(cues).write.format("chronoweft_subtitles").mode("append").save(path)
    assert (tmp_path / "out" / "_SUCCESS").exists()
    back = spark.read.format("chronoweft_subtitles").load(path)
    key = lambda rows: sorted((r["rec_id"], r["start"], r["end"], r["text"]) for r in rows)
    assert key(back.collect()) == key(cues.collect())
    sinks.to_srt(cues.filter("rec_id = 'é'")).write.format("chronoweft_subtitles").mode("overwrite").save(path)
    assert {r["rec_id"] for r in spark.read.format("chronoweft_subtitles").load(path).collect()} == {"é"}
    with pytest.raises(Exception, match="rec_id"):
        spark.createDataFrame([(None, "x")], "rec_id string, value string").write.format("chronoweft_turns").mode("append").save(path)


def test_recogniser_turns_and_scripts(spark, tmp_path):
    files.register(spark)
    (tmp_path / "nested.json").write_text('﻿{"results":{"channels":[{"alternatives":[{"words":[{"word":"hi","punctuated_word":"Hi,","start":0.5,"end":1.0,"confidence":0.9,"speaker":1},{"word":" "},7,{"word":"x","start":"no"}]}]}]}}', encoding="utf-8")
    (tmp_path / "flat.json").write_text('{"words":[{"text":"Hi","start":500,"end":1000,"speaker":"A"}]}')
    (tmp_path / "broken.json").write_text('{"words":[{"text":"Hi"')
    (tmp_path / "other.json").write_text("[1, 2]")
    got = {(r["rec_id"], r["ord"]): (r["text"], r["start"], r["end"], r["conf"], r["speaker"]) for r in spark.read.format("chronoweft_recogniser").load(str(tmp_path)).collect()}
    assert got == {("nested", 0): ("Hi,", 0.5, 1.0, 0.9, "1"), ("nested", 3): ("x", 0.0, 0.0, None, None), ("flat", 0): ("Hi", 0.5, 1.0, None, "A")}
    with pytest.raises(Exception, match="JSON|Expecting|delimiter"):
        spark.read.format("chronoweft_recogniser").option("mode", "failfast").load(str(tmp_path)).count()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>One &amp; two</w:t><w:tab/><w:t>three</w:t></w:p><w:p>Four</w:p>")
    (tmp_path / "a.docx").write_bytes(packed.getvalue())
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    (tmp_path / "c.txt").write_text("0.318 -- 6.865 speaker_00\nnoise\n7.0 -- 6.0 speaker_01\n1.2.3 -- 9 speaker_02\n")
    assert {r["rec_id"]: r["text"] for r in spark.read.format("chronoweft_scripts").load(str(tmp_path)).filter("rec_id <> 'c'").collect()} == {"a": "One & two three\nFour"}
    assert [tuple(r) for r in spark.read.format("chronoweft_turns").load(str(tmp_path)).collect()] == [("c", 0.318, 6.865, 0)]
