"""Clock, frame, level, colour and framing arithmetic as Column functions.

Every function takes Columns (or their names) and returns a Column; a null argument gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frame rates that are a whole number of thousandths over 1.001.
NTSC = (24000, 30000, 48000, 60000, 120000)
_CLOCK = r"(?:(\d+):)?(\d+):(\d+)(?:[,.](\d+))?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column) -> Column:
    """Nearest whole number, halves upward."""
    return F.floor(x + F.lit(0.5)).cast("long")


def clamp(x: Column, low: float | Column, high: float | Column) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, x))


def db_to_linear(db: Column | str) -> Column:
    """Amplitude of a level in dB."""
    return F.pow(F.lit(10.0), _c(db) / 20)


def mean_power_db(db: Column | str, floor: float = -98.5) -> Column:
    """Aggregate: level of the mean power, not below ``floor``."""
    return F.greatest(F.lit(floor), 10 * F.log10(F.avg(F.pow(F.lit(10.0), F.greatest(F.lit(floor), _c(db)) / 10))))


def heard(db: Column | str) -> Column:
    """Is there a level at all."""
    return F.coalesce(_c(db) > -99, F.lit(False))


def fps_exact(fps: Column | str) -> Column:
    """The exact rate behind a rounded one, such as 30000/1001 for 29.97; no or zero rate is 30."""
    rate = F.when(F.coalesce(_c(fps), F.lit(0.0)) == 0, F.lit(30.0)).otherwise(_c(fps).cast("double"))
    found = F.coalesce(*[F.when(F.abs(rate - n / 1001) < 0.01, F.lit(n / 1001)) for n in NTSC])
    return F.coalesce(found, rate)


def fps_rational(fps: Column | str) -> Column:
    """The rate as text: 30000/1001, 25 or 23.5."""
    rate = F.when(F.coalesce(_c(fps), F.lit(0.0)) == 0, F.lit(30.0)).otherwise(_c(fps).cast("double"))
    exact = F.coalesce(*[F.when(F.abs(rate - n / 1001) < 0.002, F.lit(f"{n}/1001")) for n in NTSC])
    whole = F.when(F.abs(rate - F.round(rate)) < 0.002, half_up(rate).cast("string"))
    return F.coalesce(exact, whole, (half_up(rate * 1000) / 1000).cast("string"))


def to_frame(seconds: Column | str, fps: Column | str) -> Column:
    """The frame a time falls on."""
    return half_up(_c(seconds) * fps_exact(fps))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _digits(x: Column, width: int) -> Column:
    text = x.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def srt_time(seconds: Column | str) -> Column:
    """HH:MM:SS,mmm of a time, rounded to the millisecond; a negative one is 0."""
    ms = half_up(F.greatest(_c(seconds), F.lit(0)) * 1000)
    h, m, s = F.expr("0") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60
    return F.concat(_digits(h.cast("long"), 2), F.lit(":"), _two(m), F.lit(":"), _two(s), F.lit(","), _digits(ms % 1000, 3))


def srt_seconds(text: Column | str) -> Column:
    """Seconds of [h:]mm:ss[,.]fraction, whatever the fraction's length; 0 where there is no clock."""
    t = F.trim(_c(text))
    part = lambda k: F.regexp_extract(t, _CLOCK, k)
    whole = lambda k: F.when(part(k) == "", F.lit(0.0)).otherwise(part(k).try_cast("double"))
    fraction = F.when(part(4) == "", F.lit(0.0)).otherwise(part(4).try_cast("double") / F.pow(F.lit(10.0), F.length(part(4))))
    return F.coalesce(F.when(t.rlike(_CLOCK), whole(1) * 3600 + whole(2) * 60 + whole(3) + fraction), F.lit(0.0))


def ass_time(seconds: Column | str) -> Column:
    """H:MM:SS.cc of a time; a negative or missing one is 0."""
    cs = half_up(F.greatest(F.coalesce(_c(seconds), F.lit(0.0)), F.lit(0)) * 100)
    return F.concat(F.floor(cs / 360000).cast("string"), F.lit(":"), _two(F.floor(cs / 6000) % 60), F.lit(":"), _two(F.floor(cs / 100) % 60), F.lit("."), _two(cs % 100))


def timecode(seconds: Column | str) -> Column:
    """M:SS, or H:MM:SS from an hour on, of whole seconds."""
    s = F.floor(F.greatest(_c(seconds), F.lit(0))).cast("long")
    h, m = F.floor(s / 3600), F.floor(s / 60)
    tail = F.concat(F.lit(":"), _two(s % 60))
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m % 60), tail)).otherwise(F.concat(m.cast("string"), tail))


def mmss(seconds: Column | str) -> Column:
    """m:ss of the nearest second, minutes running past 59."""
    s = half_up(F.greatest(F.coalesce(_c(seconds), F.lit(0.0)), F.lit(0)))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), _two(s % 60))


def clock_seconds(text: Column | str) -> Column:
    """Seconds of "m:ss" or "h:mm:ss" as a whole string; null if it is none."""
    pattern = r"^\s*(?:(\d+):)?(\d{1,3}):(\d{2})(?:\.\d+)?\s*$"
    t = _c(text)
    hours = F.coalesce(F.regexp_extract(t, pattern, 1).try_cast("double"), F.lit(0.0))
    return F.when(t.rlike(pattern), hours * 3600 + F.regexp_extract(t, pattern, 2).try_cast("double") * 60 + F.regexp_extract(t, pattern, 3).try_cast("double"))


# ---- colours ------------------------------------------------------------------


def _channel(colour: Column, at: int) -> Column:
    return F.conv(F.substring(F.regexp_replace(colour, "^#", ""), 1 + 2 * at, 2), 16, 10).cast("double")


def is_hex(colour: Column | str) -> Column:
    return F.coalesce(_c(colour).rlike("^#?[0-9A-Fa-f]{6}$"), F.lit(False))


def luminance(colour: Column | str) -> Column:
    """Relative luminance of #rrggbb; of anything else 0."""
    c = _c(colour)

    def linear(at: int) -> Column:
        v = _channel(c, at) / 255
        return F.when(v <= 0.03928, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))

    return F.when(is_hex(c), 0.2126 * linear(0) + 0.7152 * linear(1) + 0.0722 * linear(2)).otherwise(0.0)


def contrast_ratio(a: Column | str, b: Column | str) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def shade(colour: Column | str, amount: Column | float) -> Column:
    """Move a colour toward white (amount above 0) or black; what is no hex colour stays."""
    c, t = _c(colour), amount if isinstance(amount, Column) else F.lit(float(amount))
    goal, share = F.when(t >= 0, F.lit(255.0)).otherwise(0.0), F.least(F.lit(1.0), F.abs(t))
    mixed = [F.lower(F.lpad(F.hex(half_up(_channel(c, k) + (goal - _channel(c, k)) * share)), 2, "0")) for k in range(3)]
    return F.when(is_hex(c), F.concat(F.lit("#"), *mixed)).otherwise(c)


# ---- framing -------------------------------------------------------------------


def _even(x: Column) -> Column:
    """The nearest whole number, less one if odd."""
    n = half_up(x)
    return n - F.pmod(n, F.lit(2))


def _even_near(x: Column) -> Column:
    return half_up(x / 2) * 2


def region_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A region in shares of the frame as pixels inside it, at least 2 by 2; missing parts are the whole frame."""
    px, py = F.greatest(F.lit(0), half_up(F.coalesce(x, F.lit(0.0)) * width)), F.greatest(F.lit(0), half_up(F.coalesce(y, F.lit(0.0)) * height))
    pw, ph = F.least(width - px, half_up(F.coalesce(w, F.lit(1.0)) * width)), F.least(height - py, half_up(F.coalesce(h, F.lit(1.0)) * height))
    return F.struct(px.alias("x"), py.alias("y"), F.greatest(F.lit(2), pw).cast("long").alias("w"), F.greatest(F.lit(2), ph).cast("long").alias("h"))


def _window(cx: Column, top: Column, cw: Column, ch: Column, width: Column, height: Column) -> Column:
    x, y = clamp(cx - cw / 2, 0.0, width - cw), clamp(top, 0.0, height - ch)
    return F.struct(_even(x).alias("x"), _even(y).alias("y"), _even(cw).alias("w"), _even(ch).alias("h"))


def _full(width: Column, height: Column, aspect: Column) -> tuple[Column, Column]:
    """The largest window of an aspect in the frame."""
    wide = height * aspect > width
    return F.when(wide, width).otherwise(height * aspect), F.when(wide, width / aspect).otherwise(height)


def face_crop(cx: Column, cy: Column, size: Column, width: Column, height: Column, aspect: Column, min_height: float = 0.5, face_share: float = 0.34, fallback: float = 0.5) -> Column:
    """A window around a face: the face fills at least ``face_share`` of its width, its middle is 36 % from the top, and it keeps ``min_height`` of the frame. Without a face it is the largest window, centred at ``fallback``."""
    full_w, full_h = _full(width, height, aspect)
    want = size * width / face_share
    cw = F.when(want < full_w, F.least(full_w, F.greatest(min_height * height * aspect, want))).otherwise(full_w)
    ch = F.when(want < full_w, cw / aspect).otherwise(full_h)
    found = _window(cx * width, cy * height - ch * 0.36, cw, ch, width, height)
    middle = F.struct(_even(clamp(fallback * width - full_w / 2, 0.0, width - full_w)).alias("x"), _even((height - full_h) / 2).alias("y"), _even(full_w).alias("w"), _even(full_h).alias("h"))
    return F.when(cx.isNull(), middle).otherwise(found)


def face_crops(faces: DataFrame, min_height: float = 0.5, face_share: float = 0.34, fallback: float = 0.5) -> DataFrame:
    """Adds ``c``, what ``face_crop`` makes of the columns cx, cy, size, width, height and aspect.

    Step by step, each a projection of its own: as one expression, the window's size is computed anew wherever it is
    named, and the code becomes too long to be compiled.
    """
    cx, cy, width, height, aspect = (F.col(n) for n in ("cx", "cy", "width", "height", "aspect"))
    full_w, full_h = _full(width, height, aspect)
    rows = faces.withColumns({"_fw": full_w, "_fh": full_h, "_want": F.col("size") * width / face_share})
    less = F.col("_want") < F.col("_fw")
    rows = rows.withColumn("_cw", F.when(less, F.least(F.col("_fw"), F.greatest(min_height * height * aspect, F.col("_want")))).otherwise(F.col("_fw")))
    rows = rows.withColumn("_ch", F.when(less, F.col("_cw") / aspect).otherwise(F.col("_fh")))
    blind = cx.isNull()
    side = {"_cw": F.when(blind, F.col("_fw")).otherwise(F.col("_cw")), "_ch": F.when(blind, F.col("_fh")).otherwise(F.col("_ch"))}
    left = F.when(blind, fallback * width - F.col("_fw") / 2).otherwise(cx * width - F.col("_cw") / 2)
    top = F.when(blind, (height - F.col("_fh")) / 2).otherwise(clamp(cy * height - F.col("_ch") * 0.36, 0.0, height - F.col("_ch")))
    rows = rows.withColumns({"_x": clamp(left, 0.0, width - side["_cw"]), "_y": top} | {k: v for k, v in side.items()})
    whole = {n: half_up(F.col(n)) for n in ("_x", "_y", "_cw", "_ch")}
    even = F.struct(*[(F.col(n) - F.pmod(n, F.lit(2))).alias(m) for n, m in (("_x", "x"), ("_y", "y"), ("_cw", "w"), ("_ch", "h"))])
    return rows.withColumns(whole).select(*faces.columns, even.alias("c"))


def mark_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, aspect: Column, min_height: float = 0.4) -> Column:
    """A window around a marked box with 8 % to spare, its top near the window's."""
    tall = F.least(height, F.greatest(min_height * height, h * height * 1.08, w * width * 1.08 / aspect))
    wide = tall * aspect
    cw, ch = F.when(wide > width, width).otherwise(wide), F.when(wide > width, width / aspect).otherwise(tall)
    return _window((x + w / 2) * width, y * height - ch * 0.04, cw, ch, width, height)


def cell_motion(crop: Column, width: Column, height: Column, cell: Column, mode: str = "cover") -> Column:
    """Scale (%), place of the clip's centre, and crop (%) that show ``crop`` of the source in ``cell``. mode: cover, fit or stretch."""
    along, down = cell["w"] / crop["w"], cell["h"] / crop["h"]
    s = {"cover": F.greatest(along, down), "fit": F.least(along, down), "stretch": along}[mode]
    vw, vh = (cell["w"] / s, cell["h"] / s) if mode == "cover" else (crop["w"], crop["h"])
    x, y = crop["x"] + (crop["w"] - vw) / 2, crop["y"] + (crop["h"] - vh) / 2
    share = lambda v, of: clamp(v / of * 100, 0.0, 100.0)
    return F.struct(
        (s * 100).alias("scale"),
        (cell["x"] + cell["w"] / 2 + (width / 2 - (x + vw / 2)) * s).alias("x"),
        (cell["y"] + cell["h"] / 2 + (height / 2 - (y + vh / 2)) * s).alias("y"),
        share(x, width).alias("left"), share(y, height).alias("top"),
        share(width - x - vw, width).alias("right"), share(height - y - vh, height).alias("bottom"),
    )


def layout_cells(layout: Column | str, width: Column, height: Column) -> Column:
    """Cells of a layout: array of x, y, w, h, role. Layouts: split, bigsmall, pip, three, fit; any other is one cell."""
    cell = lambda x, y, w, h, role: F.struct(*[v.cast("long").alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"))], F.lit(role).alias("role"))
    zero, half, big, third = F.lit(0), _even_near(height / 2), _even_near(height * 0.62), _even_near(height / 3)
    pw, margin = _even_near(width * 0.36), _even_near(width * 0.04)
    whole = cell(zero, zero, width, height, "main")
    name = _c(layout)
    return (
        F.when(name == "split", F.array(cell(zero, zero, width, half, "main"), cell(zero, half, width, height - half, "other")))
        .when(name == "bigsmall", F.array(cell(zero, zero, width, big, "main"), cell(zero, big, width, height - big, "other")))
        .when(name == "pip", F.array(whole, cell(width - pw - margin, _even_near(height * 0.08), pw, _even_near(pw * 4 / 3), "other")))
        .when(name == "three", F.array(cell(zero, zero, width, third, "main"), cell(zero, third, width, third, "other"), cell(zero, 2 * third, width, height - 2 * third, "third")))
        .otherwise(F.array(whole))
    )
