"""The timeline database: clips on tracks of sequences, nested sequences, edits and markers.

clip: sequence_id, track, kind (audio/video), clip_id, name, media, nested_id, start, end, in_point, out_point, speed,
reversed, disabled, selected; track: sequence_id, track, kind, name, muted, locked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweft.operators import intervals
from chronoweft.operators.clusters import first_kept

# Files that are pictures, graphics or projects, without sound.
NOT_AUDIO = r"(?i)\.(aegraphic|mogrt|prproj|psd|ai|png|jpe?g|gif|tiff?|svg|eps|bmp|webp|heic)$"
MAX_DEPTH = 4


def clip_speed(reported: Column, start: Column, end: Column, in_point: Column, out_point: Column) -> Column:
    """The speed reported (over 20: a percentage), else the media's span over the timeline's."""
    said = F.when(reported > 20, reported / 100).otherwise(reported)
    return F.when(said > 0, said).when((out_point > in_point) & (end > start), (out_point - in_point) / (end - start)).otherwise(1.0)


def sources(clips: DataFrame, tracks: DataFrame) -> DataFrame:
    """Clips with their tracks and the sequence's selected span."""
    span = Window.partitionBy("sequence_id")
    chosen = F.coalesce(F.col("selected"), F.lit(False))
    both = clips.join(tracks.select("sequence_id", "kind", "track", F.col("name").alias("track_name"), "muted", "locked"), ["sequence_id", "kind", "track"])
    return both.withColumn("selection_start", F.min(F.when(chosen, F.col("start"))).over(span)).withColumn("selection_end", F.max(F.when(chosen, F.col("end"))).over(span))


def flatten_nests(clips: DataFrame, tracks: DataFrame, sequence_id: str | None = None, sliver: float = 0.01) -> DataFrame:
    """Audio of every sequence, or of one, and of what is nested in it, on its clock: sequence_id, depth, path, track, clip_id, media, start, end, in_point, out_point, speed, reversed, disabled, muted.

    Nests are followed to a depth of four and never into a sequence that is already on the path.  All nests of one
    depth are opened by one join, those of all sequences together.
    """
    audio = clips.filter("kind = 'audio'").join(tracks.filter("kind = 'audio'").select("sequence_id", "track", F.coalesce("muted", F.lit(False)).alias("_muted")), ["sequence_id", "track"])
    audio = audio.filter((F.col("end") - F.col("start") > sliver) & (F.col("media").isNull() | ~F.col("media").rlike(NOT_AUDIO)))
    audio = audio.withColumn("speed", clip_speed(F.col("speed"), F.col("start"), F.col("end"), F.col("in_point"), F.col("out_point")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    inner = audio.select(
        F.col("sequence_id").alias("_seq"), F.col("track").alias("_t"), F.col("clip_id").alias("_id"), F.col("media").alias("_media"), F.col("nested_id").alias("_nest"), F.col("start").alias("_s"), F.col("end").alias("_e"),
        F.col("in_point").alias("_i"), F.col("speed").alias("_v"), flag("reversed").alias("_r"), flag("disabled").alias("_d"), F.col("_muted").alias("_m"),
    )
    roots = audio if sequence_id is None else audio.filter(F.col("sequence_id") == sequence_id)
    level = roots.select(
        "sequence_id", F.lit(0).alias("depth"), F.array("sequence_id").alias("path"), "track", "clip_id", "media", "nested_id", "start", "end", "in_point", "speed", flag("reversed").alias("reversed"), flag("disabled").alias("disabled"), F.col("_muted").alias("muted")
    )
    found = level.filter(F.col("media").isNotNull())
    for depth in range(1, MAX_DEPTH + 1):
        nests = level.filter(F.col("media").isNull() & F.col("nested_id").isNotNull() & ~F.array_contains("path", F.col("nested_id")))
        last = F.col("in_point") + (F.col("end") - F.col("start")) * F.col("speed")
        both = nests.withColumn("_out", last).join(inner, (F.col("nested_id") == F.col("_seq")) & (F.col("_e") > F.col("in_point")) & (F.col("_s") < F.col("_out")))
        vs, ve = F.greatest("_s", "in_point"), F.least("_e", "_out")
        level = both.filter(ve - vs > sliver).select(
            "sequence_id", F.lit(depth).alias("depth"), F.concat("path", F.array("nested_id")).alias("path"), F.col("_t").alias("track"), F.col("_id").alias("clip_id"), F.col("_media").alias("media"), F.col("_nest").alias("nested_id"),
            (F.col("start") + (vs - F.col("in_point")) / F.col("speed")).alias("start"), (F.col("start") + (ve - F.col("in_point")) / F.col("speed")).alias("end"), (F.col("_i") + (vs - F.col("_s")) * F.col("_v")).alias("in_point"),
            (F.col("speed") * F.col("_v")).alias("speed"), (F.col("reversed") | F.col("_r")).alias("reversed"), (F.col("disabled") | F.col("_d")).alias("disabled"), (F.col("muted") | F.col("_m")).alias("muted"),
        )
        found = found.unionByName(level.filter(F.col("media").isNotNull()))
    return found.drop("nested_id").withColumn("out_point", F.col("in_point") + (F.col("end") - F.col("start")) * F.col("speed"))


def fingerprint(clips: DataFrame) -> DataFrame:
    """Order-insensitive summary of each sequence: sequence_id, n, start_ms, last."""
    return clips.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("start") * 1000 + 0.5).cast("long")).alias("start_ms"), F.max("end").alias("last"))


def merge_host(ranges: DataFrame) -> DataFrame:
    """Union of ranges as the host takes them: none of at most 0.02 s, joined within 0.04 s."""
    return intervals.merge(ranges, 0.04, 0.02)


def shift_markers(markers: DataFrame, cuts: DataFrame, preview: str | None = None) -> DataFrame:
    """Markers slid left by the time cut before them; preview markers (their label, perhaps with a number) go. markers: rec_id, ord, name, start, end."""
    import re

    kept = markers if not preview else markers.filter(~F.coalesce("name", F.lit("")).rlike("^" + re.escape(preview) + r"( \d+)?$"))
    at = lambda c: intervals.removed_before(kept.select("rec_id", "ord", F.col(c).alias("t")), cuts).select("rec_id", "ord", (F.col("t") - F.col("removed")).alias(f"_{c}"))
    both = kept.join(at("start"), ["rec_id", "ord"]).join(at("end"), ["rec_id", "ord"])
    return both.withColumn("start", F.col("_start")).withColumn("end", F.greatest("_start", "_end")).drop("_start", "_end")


def clips_in_range(clips: DataFrame, start: float, end: float, slack: float = 0.001) -> DataFrame:
    """Clips whose middle lies strictly inside a range."""
    middle = (F.col("start") + F.col("end")) / 2
    return clips.filter((middle > F.lit(start + slack)) & (middle < F.lit(end - slack)))


def razor_ripple(clips: DataFrame, cuts: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """The clip table after cuts: clips split at the cuts, what lies in them gone, gaps closed on all tracks alike. clips: rec_id, ord, start, end, in_point, speed, ...; recordings with a locked track (locked: rec_id) stay as they are."""
    free = clips if locked is None else clips.join(locked.select("rec_id").distinct(), "rec_id", "left_anti")
    solid = merge_host(cuts).select("rec_id", "start", "end").withColumn("ord", F.monotonically_increasing_id())
    before = free.withColumn("_s0", F.col("start"))
    left = intervals.subtract(before, solid, 0.0)
    moved = left.withColumn("in_point", F.col("in_point") + (F.col("start") - F.col("_s0")) * F.col("speed"))
    numbered = moved.withColumn("_p", F.row_number().over(Window.partitionBy("rec_id", "ord").orderBy("start"))).withColumn("_o", F.col("ord")).withColumn("ord", F.struct("ord", "_p"))
    out = intervals.ripple(numbered, solid, kind="lines", floor=0.0).withColumn("ord", F.col("_o")).withColumn("part", F.col("_p")).drop("_s0", "_p", "_o")
    return out if locked is None else out.unionByName(clips.join(locked.select("rec_id").distinct(), "rec_id", "left_semi").withColumn("part", F.lit(1)))


def snap_plan(plan: DataFrame, fps: float) -> DataFrame:
    """Shots on frames, those under a frame joined to the one before: rec_id, s, e, angle."""
    from chronoweft.functions.timecode import half_up

    w = Window.partitionBy("rec_id").orderBy("start")
    rows = plan.select("rec_id", "start", "angle", half_up(F.col("start") * fps).alias("s"), half_up(F.col("end") * fps).alias("e")).filter("e > s")
    fresh = rows.withColumn("_g", F.sum(F.when(F.lag("angle").over(w) == F.col("angle"), 0).otherwise(1)).over(w))
    return fresh.groupBy("rec_id", "_g", "angle").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_g")


def transcribe_source(flat: DataFrame) -> DataFrame:
    """The media that covers most sound of a sequence: media, coverage. Reversed and disabled clips don't count, muted ones only if there are no others."""
    usable = flat.filter(~F.col("reversed") & ~F.col("disabled"))
    per = usable.groupBy("media").agg(F.min(F.col("muted").cast("int")).alias("muted"), F.sum(F.when(F.col("muted"), 0.0).otherwise(F.col("end") - F.col("start"))).alias("heard"), F.sum(F.col("end") - F.col("start")).alias("all"))
    return per.orderBy("muted", F.desc("heard"), F.desc("all"), "media").limit(1).select("media", F.when(F.col("muted") == 1, F.col("all")).otherwise(F.col("heard")).alias("coverage"))


def free_name(name: str, taken: DataFrame) -> DataFrame:
    """The first of "name", "name 2", "name 3", ... that isn't taken (taken: name), however many are."""
    number = F.when(F.col("name") == name, F.lit(1)).otherwise(F.expr(f"try_cast(substring(name, {len(name) + 2}) as bigint)"))
    said = F.when(number == 1, F.lit(name)).otherwise(F.concat(F.lit(f"{name} "), number.cast("string")))
    used = taken.filter(F.col("name").startswith(name)).select(number.alias("n"), "name").filter((F.col("n") >= 1) & (F.col("name") == said)).select("n").distinct()
    # numbers without a gap from 1 on are their own ranks; one row for each such name
    gapless = used.withColumn("_r", F.row_number().over(Window.orderBy("n"))).filter("n = _r").agg((F.coalesce(F.max("n"), F.lit(0)) + 1).alias("n"))
    return gapless.select(F.when(F.col("n") == 1, F.lit(name)).otherwise(F.concat(F.lit(f"{name} "), F.col("n").cast("string"))).alias("name"))


def mix_plan(clips: DataFrame, span: tuple[float, float] | None = None, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """What a mix of the live tracks hears: pieces (rec_id, track, media, start, end, from, to, speed, reversed, streams) and inputs (rec_id, media, from, to, streams). A piece that starts, in the mix and in its media, within the tolerance of one before it (by track, start, end, from, to and speed) and plays at its speed is that one's further stream."""
    live = clips.filter(~F.coalesce("muted", F.lit(False)) & ~F.coalesce("disabled", F.lit(False)) & F.col("media").isNotNull() & ~F.col("media").rlike(NOT_AUDIO) & (F.col("end") - F.col("start") > 0.05))
    live = live.withColumn("speed", clip_speed(F.col("speed"), F.col("start"), F.col("end"), F.col("in_point"), F.col("out_point")))
    live = live.withColumn("out_point", F.when(F.col("out_point") > F.col("in_point"), F.col("out_point")).otherwise(F.col("in_point") + (F.col("end") - F.col("start")) * F.col("speed")))
    s, e = (F.col("start"), F.col("end")) if not span else (F.greatest("start", F.lit(span[0])), F.least("end", F.lit(span[1])))
    back = F.coalesce("reversed", F.lit(False))
    a = F.when(back, F.col("out_point") - (e - F.col("start")) * F.col("speed")).otherwise(F.col("in_point") + (s - F.col("start")) * F.col("speed"))
    b = F.when(back, F.col("out_point") - (s - F.col("start")) * F.col("speed")).otherwise(F.col("in_point") + (e - F.col("start")) * F.col("speed"))
    cut = live.select("rec_id", "track", "media", s.alias("start"), e.alias("end"), a.alias("from"), b.alias("to"), "speed", back.alias("reversed")).filter(F.col("end") - F.col("start") > 0.02)
    order = ["track", "start", "end", "from", "to", "speed"]
    met = first_kept(cut, ["rec_id", "media", "reversed"], order, {"start": tolerance, "from": tolerance, "speed": 1e-3})
    pieces = met.groupBy("rec_id", "media", "reversed", "leader").agg(F.count(F.lit(1)).alias("streams")).select("rec_id", "media", "reversed", "leader.*", "streams")
    inputs = pieces.groupBy("rec_id", "media").agg(F.greatest(F.lit(0.0), F.min("from") - 0.5).alias("from"), (F.max("to") + 0.5).alias("to"), F.max("streams").alias("streams"))
    return pieces, inputs


def piece_gains(pieces: DataFrame) -> DataFrame:
    """Gain of each cut to the weighted middle loudness of its recording: adds gain. A change under 1 dB is none, the most is 10 dB; a cut too short to measure takes the last gain of its source. pieces: rec_id, ord, src, dur, lufs."""
    good = F.coalesce((F.col("lufs") > -60) & (F.col("dur") >= 0.8), F.lit(False))
    w = Window.partitionBy("rec_id").orderBy("lufs", "ord")
    ranked = pieces.filter(good).withColumn("_u", F.sum("dur").over(w)).withColumn("_t", F.sum("dur").over(Window.partitionBy("rec_id")))
    middle = ranked.filter(F.col("_u") >= F.col("_t") / 2).groupBy("rec_id").agg(F.min("lufs").alias("_m"))
    raw = F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("_m") - F.col("lufs")))
    own = F.when(good, F.when(F.abs(raw) < 1, 0.0).otherwise(raw))
    last = F.last("_g", ignorenulls=True).over(Window.partitionBy("rec_id", "src").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pieces.join(middle, "rec_id", "left").withColumn("_g", own).withColumn("gain", F.floor(F.coalesce(last, F.lit(0.0)) * 10 + 0.5) / 10).drop("_g", "_m")


# Kinds of assets by extension and by name, and their folders.
EXTENSIONS = {
    "afterEffects": "aep aet aegraphic mogrt", "caption": "srt vtt scc stl dfxp mcc itt", "lut": "cube 3dl look lut", "projectData": "prproj xml edl aaf fcpxml json", "document": "pdf doc docx txt rtf csv",
    "graphic": "psd ai eps svg", "image": "jpg jpeg png gif tif tiff bmp webp heic raw dng", "video": "mp4 mov m4v mxf avi mkv webm mts m2ts r3d braw", "audio": "wav mp3 aac m4a aif aiff flac ogg",
}
FOLDERS = {
    "sequence": "Sequences", "video": "Video", "proxy": "Video/Proxies", "image": "Images & Photos", "music": "Audio/Music", "sfx": "Audio/Sound Effects (SFX)", "voiceover": "Audio/Voiceover & Dialogue", "audio": "Audio/Other Audio",
    "graphic": "Graphics & Titles", "caption": "Captions & Subtitles", "generated": "Adjustment & Generated Media", "lut": "LUTs & Presets", "afterEffects": "Project & Data Files", "projectData": "Project & Data Files", "document": "Project & Data Files",
}


def asset_class(name: Column, media: Column, is_sequence: Column) -> Column:
    """The kind of an asset by its extension, then its name."""
    both = F.concat_ws(" ", name, media)
    ext = F.lower(F.regexp_extract(F.coalesce(media, name), r"\.([A-Za-z0-9]+)$", 1))
    edge = lambda ws: both.rlike(rf"(?i)(^|[\s._-])({ws})($|[\s._-])")
    sound = F.when(edge("vo|voiceover|voice-over|narration|dialogue|dialog|adr"), "voiceover").when(edge("music|song|score|soundtrack|bgm|instrumental|theme"), "music").when(edge("sfx|sound-effect|sound_effect|soundeffect|foley|ambience|ambient|whoosh|impact|riser|roomtone|room-tone"), "sfx").otherwise("audio")
    out = F.lit("other")
    for kind, names in reversed(EXTENSIONS.items()):
        value = sound if kind == "audio" else F.when(edge("proxy|proxies"), "proxy").otherwise("video") if kind == "video" else F.lit(kind)
        out = F.when(ext.isin(*names.split()), value).otherwise(out)
    made = name.rlike(r"(?i)^(adjustment layer|bars and tone|black video|color matte|transparent video|universal counting leader)")
    return F.when(made, "generated").when(is_sequence, "sequence").otherwise(out)


def asset_folder(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), kind), F.lit("Other"))


def error_kind(status: Column, curl: Column, raw: Column) -> Column:
    """What a provider's error means, by ordered rules on its status, connection error and text."""
    raw = F.coalesce(raw, F.lit(""))
    says = lambda p: raw.rlike("(?i)" + p)
    code = lambda *n: F.coalesce(status.isin(*n), F.lit(False))
    return (
        F.when(curl.isin(5, 6, 7, 28, 35, 52, 56), "network").when(curl.isNotNull() & (curl != 0), "request_failed")
        .when(code(401, 403) | says("invalid[ _-]?api[ _-]?key|invalid[ _-]?auth|invalid credential|unauthori[sz]ed|authentication fail|invalid token|not authorized|forbidden|permission denied"), "bad_key")
        .when(says(r"does not exist or you do not have access|model_not_found|decommissioned|\bmodel\b[\s\S]{0,40}not found"), "model_gone")
        .when(code(429) | says("rate.?limit|too many requests|quota exceeded|tokens per (minute|day)"), "rate_limit")
        .when(code(402) | says("insufficient|billing|payment required|out of credit|no credit"), "no_credit")
        .when(code(500, 502, 503) | says("service unavailable|internal server error|over capacity|temporarily unavailable"), "provider_down")
        .when(code(413) | says("too large|payload too large|exceeds maximum|file size"), "too_large")
        .when(says("no speech|returned no words|empty transcript|no audio|could not detect"), "no_speech")
        .when(code(415) | says("unsupported (media|format)|invalid (audio|file|format)|could not decode"), "bad_audio")
        .otherwise("unknown")
    )


def pieces_of(clips: DataFrame) -> DataFrame:
    """Clips that can be mixed as they are: media, not muted, disabled or reversed, at normal speed: rec_id, track, media, from, dur, at."""
    flag = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    plain = clips.filter(F.col("media").isNotNull() & flag("muted") & flag("disabled") & flag("reversed") & (F.abs(F.coalesce("speed", F.lit(1.0)) - 1) <= 0.001))
    return plain.select("rec_id", "track", "media", F.col("in_point").alias("from"), (F.col("end") - F.col("start")).alias("dur"), F.col("start").alias("at"))


def families(names: DataFrame, query: str) -> DataFrame:
    """Names that contain the query, whatever the case; all for an empty one."""
    q = (query or "").strip().lower()
    return names.filter(F.lower("name").contains(q)) if q else names
