"""Rows as subtitle files, subtitle scripts, chapter lists and overlay lists, one text for each recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.functions.text import ass_text
from chronoweft.functions.timecode import ass_time, fps_rational, half_up, srt_time, timecode

KEY = "rec_id"


def _joined(rows: DataFrame, line: Column, *order: str, between: str = "\n", head: str = "") -> DataFrame:
    """A text of each recording's lines in order."""
    lines = rows.select(KEY, F.struct(*order, line.alias("_line")).alias("_l")).groupBy(KEY).agg(F.array_sort(F.collect_list("_l")).alias("_ls"))
    return lines.select(KEY, F.concat(F.lit(head), F.array_join(F.transform("_ls", lambda x: x["_line"]), between)).alias("value"))


def to_srt(cues: DataFrame) -> DataFrame:
    """rec_id, value. cues: rec_id, i, start, end, text; blank lines inside a text go."""
    n = F.row_number().over(Window.partitionBy(KEY).orderBy("start", "i"))
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"\n[ \t]*(?=\n)", "")
    rows = cues.withColumn("_n", n)
    return _joined(rows, F.concat(F.col("_n").cast("string"), F.lit("\n"), srt_time("start"), F.lit(" --> "), srt_time("end"), F.lit("\n"), body, F.lit("\n")), "_n")


def to_chapters(chapters: DataFrame) -> DataFrame:
    """Lines of time and title."""
    return _joined(chapters, F.concat(timecode("start"), F.lit(" "), F.col("title")), "start")


def events(cues: DataFrame) -> DataFrame:
    """Word-timed or plain cues as events: rec_id, i, words (text, start, end); a plain cue is one word."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    plain = F.array(F.struct(text.alias("text"), F.col("start"), F.coalesce("end", F.col("start") + 1).alias("end")))
    has = F.coalesce(F.size("words"), F.lit(-1)) > 0
    return cues.select(KEY, "i", F.when(has, F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["start"].alias("start"), w["end"].alias("end")))).when(text != "", plain).alias("words")).filter(F.col("words").isNotNull())


def to_ass(cues: DataFrame, width: int = 1920, height: int = 1080, font: str = "Arial", size: int = 60, fill: str = "&HFFFFFF&", highlight: str = "&H00D4FF&", outline: str = "&H000000&") -> DataFrame:
    """A subtitle script that lights up each word as it is spoken: rec_id, value. cues: rec_id, i, start, end, text, words."""
    head = "\n".join(
        [
            "[Script Info]", "ScriptType: v4.00+", f"PlayResX: {width}", f"PlayResY: {height}", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "", "[V4+ Styles]",
            "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding",
            f"Style: Caption,{font},{size},{fill},{highlight},{outline},&H64000000&,0,0,0,0,100,100,0,0,1,4,0,2,{round(width * 0.06)},{round(width * 0.06)},{round(height * 0.12)},1",
            "", "[Events]", "Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text", "",
        ]
    )
    rows = events(cues).select(KEY, "i", "words", F.posexplode("words").alias("k", "w"))
    nxt = F.get("words", F.col("k") + 1)["start"]
    end = F.coalesce(nxt, F.col("w.end"))
    end = F.when(end > F.col("w.start"), end).otherwise(F.col("w.start") + 0.04)
    lit_ = lambda w, j: F.when(j == F.col("k"), F.concat(F.lit("{\\1c" + highlight + "}"), ass_text(w["text"]), F.lit("{\\1c" + fill + "}"))).otherwise(ass_text(w["text"]))
    line = F.concat(F.lit("Dialogue: 0,"), ass_time("w.start"), F.lit(","), ass_time("_end"), F.lit(",Caption,,0,0,0,,"), F.array_join(F.transform("words", lit_), " "))
    return _joined(rows.withColumn("_end", end), line, "i", "k", head=head)


def to_concat(plan: DataFrame, fps: float, prefix: str = "state-") -> DataFrame:
    """A list of still files with durations that add up to the microsecond: rec_id, value. plan: rec_id, segment, state, frames."""
    w = Window.partitionBy(KEY).orderBy("segment")
    upto = F.sum("frames").over(w)
    micro = lambda n: half_up(n * 1_000_000 / F.lit(fps))
    length = (micro(upto) - micro(upto - F.col("frames"))) / 1_000_000
    line = F.concat(F.lit(f"file '{prefix}"), F.col("state").cast("string"), F.lit(".png'\noption framerate "), fps_rational(F.lit(fps)), F.lit("\nduration "), F.format_string("%.6f", "_d"))
    return _joined(plan.withColumn("_d", length), line, "segment", head="ffconcat version 1.0\n")


def write_texts(texts: DataFrame, path: str) -> None:
    """Write each recording's text into a folder of its own."""
    texts.select(KEY, "value").write.partitionBy(KEY).option("lineSep", "").text(path)
