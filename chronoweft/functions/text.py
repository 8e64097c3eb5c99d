"""Text of words, cues and lines as Column functions; the few that built-in functions can't express are Arrow UDFs.

A null text is an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoweft.functions import words as lists

LETTERS = r"A-Za-z0-9_\x{0900}-\x{0963}\x{0966}-\x{097F}"
_KEY = r"a-z0-9'\x{0900}-\x{0963}\x{0966}-\x{097F}"
#: The same in Python's patterns.
PLAIN_KEY = "a-z0-9'\u0900-\u0963\u0966-\u097f"
_CURLY = "‘’ʼ`"


def _c(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def _among(word: Column, of: list[str]) -> Column:
    return word.isin(*of)


def _pattern(choices: str, anchored: bool = False) -> str:
    """Any of the choices as a whole word, where a danda ends a word like a full stop."""
    return rf"(?i)(?:{'^' if anchored else f'(?:^|[^{LETTERS}])'})(?:{choices})(?=$|[^{LETTERS}])"


# ---- keys of words: each normalises in its own way -----------------------------------


def straight(text: Column | str) -> Column:
    """Lower case with straight apostrophes."""
    return F.translate(F.lower(_c(text)), _CURLY, "''''")


def spoken(word: Column | str) -> Column:
    """Letters, marks and digits of any script, inner apostrophes kept. Text is taken to be composed (see ``compose``)."""
    return F.regexp_replace(F.regexp_replace(straight(word), r"[^\p{L}\p{M}\p{N}']", ""), "^'+|'+$", "")


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """Unicode composition (NFC)."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def keyword(word: Column | str) -> Column:
    """a-z, digits, apostrophes and Devanagari without dandas."""
    return F.regexp_replace(F.lower(_c(word)), f"[^{_KEY}]", "")


def raw_tokens(text: Column | str) -> Column:
    """Keywords of a text, in order, with apostrophes at their ends, and empty strings."""
    return F.split(straight(text), f"[^{_KEY}]+")


def tokens(text: Column | str) -> Column:
    """Keywords of a text, in order."""
    return F.filter(F.transform(raw_tokens(text), lambda t: F.btrim(t, F.lit("'"))), lambda t: t != "")


def script_word(word: Column | str) -> Column:
    """Word characters, Devanagari and inner apostrophes; dandas end a word."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(word)), r"[^A-Za-z0-9_\x{0900}-\x{097F}']+|[।॥]", ""), "^'+|'+$", "")


def edge_trimmed(word: Column | str) -> Column:
    """Lower case without brackets, quotes and stops at the ends."""
    return F.regexp_replace(F.lower(_c(word)), r"""^[\s"'“”‘’(\[¿¡]+|[\s"'“”‘’)\].,!?;:…।॥۔؟-]+$""", "")


def file_word(word: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(word)), r"^[^a-z0-9\x{0900}-\x{0963}\x{0966}-\x{097F}]+|[^a-z0-9\x{0900}-\x{0963}\x{0966}-\x{097F}]+$", "")


def topic_word(word: Column | str) -> Column:
    return F.regexp_replace(keyword(word), "^'+|'+$", "")


def topic_words(text: Column | str, stop: list[str] | None = None) -> Column:
    """Words that can name a topic: no glue words, no contractions, four Latin letters or two others at least."""
    # all words are cleaned in one text: what is in none goes, then apostrophes at their ends
    clean = F.regexp_replace(F.lower(_c(text)), rf"[^{_KEY}\s]+", "")
    parts = F.split(F.regexp_replace(clean, r"(?<!\S)'++|(?<!')'++(?!\S)", ""), r"\s+")
    long = lambda t: F.length(t) >= F.when(F.octet_length(t) == F.length(t), 4).otherwise(2)
    return F.filter(parts, lambda t: (t != "") & ~_among(t, stop or lists.TOPIC_STOP) & ~t.contains("'") & long(t))


def bare(word: Column | str) -> Column:
    return F.regexp_replace(F.lower(_c(word)), f"[^{_KEY}]", "")


# ---- words -----------------------------------------------------------------------------


def is_hesitation(word: Column | str) -> Column:
    return _among(edge_trimmed(word), lists.HESITATIONS)


def is_filler(word: Column | str, extra: bool = False) -> Column:
    return _among(spoken(word), [*lists.FILLERS, *(lists.EXTRA_FILLERS if extra else [])])


def strip_punctuation(word: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(word), r"""^[\s"'“”‘’(\[{¿¡]+""", ""), r"""[\s"'“”‘’.,!?;:)\]}…—–]+$""", "")


#: Letters whose capital is written with several; alone they have a capital of one letter, or none.
_WIDE = "".join(c for c in map(chr, range(0x110000)) if len(c.upper()) > 1)
_NARROW = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _WIDE)


def raised(letter: Column) -> Column:
    """A letter's capital, one letter as well."""
    return F.when(F.length(F.upper(letter)) > 1, F.translate(letter, _WIDE, _NARROW)).otherwise(F.upper(letter))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once for all its uses, those inside of lambdas too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def case_word(word: Column | str, mode: str) -> Column:
    w = _c(word)
    if mode in ("lower", "sentence"):
        return F.lower(w)
    if mode == "title":
        return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))
    return F.upper(w) if mode == "upper" else w


def case_words(array: Column, mode: str) -> Column:
    """Words in a case; ``sentence`` raises the first Latin letter's word."""
    cased = F.transform(array, lambda w: case_word(w, mode))
    if mode != "sentence":
        return cased
    place = lambda ws: F.array_position(F.transform(ws, lambda w: w.rlike("[A-Za-z]")), True)
    head = lambda w: F.concat(raised(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    return _once(cased, lambda ws: _once(place(ws), lambda first: F.transform(ws, lambda w, k: F.when(k + 1 == first, head(w)).otherwise(w))))


def censor(word: Column | str, listed: list[str] | None = None) -> Column:
    """A listed word with stars for all letters after the first; vowel signs go."""
    w = _c(word)
    plain = F.regexp_replace(F.lower(w), r"[^a-z\x{0900}-\x{0963}\x{0966}-\x{097F}]", "")
    starred = F.regexp_replace(F.regexp_replace(w, r"(?<=[A-Za-z\x{0900}-\x{0963}\x{0966}-\x{097F}])[\x{093A}-\x{094F}\x{0900}-\x{0903}\x{0962}\x{0963}]", ""), r"(?<=[A-Za-z\x{0900}-\x{0963}\x{0966}-\x{097F}].{0,80})[A-Za-z\x{0900}-\x{0963}\x{0966}-\x{097F}]", "*")
    return F.when(_among(plain, listed or lists.PROFANITY), starred).otherwise(w)


def is_sentence_end(word: Column | str) -> Column:
    """Ends with a full stop, danda, question or exclamation mark that isn't part of an abbreviation or initial."""
    w = F.regexp_replace(_c(word), r"""["'»)\]”’]+$""", "")
    core = F.regexp_replace(w, r"\.+$", "")
    initial = (core.rlike(r"^([A-Za-z]\.)*[A-Za-z]$") & core.rlike("[A-Z]")) | core.rlike(r"^([a-z]\.)+[a-z]$")
    return w.rlike(r"[!?।॥۔]$") | (w.rlike(r"\.$") & ~_among(F.lower(core), lists.ABBREVIATIONS) & ~initial)


def line_break_cost(before: Column | str, after: Column | str, hinglish: Column | None = None) -> Column:
    """What a line break between two words costs: 0 after a sentence to 3 after a word no line ends on; infinite where grammar forbids it."""
    p, n = _c(before), _c(after)
    pb, nb = bare(p), bare(n)
    never = F.lit(float("inf"))
    hindi_verb = pb.rlike("(te|ti|ta|ye|ae|aye|rahe|gaye|hue|baithe|kar|liye|diye|kiye)$")
    the_verb = (nb == "the") & (F.when(hinglish, hindi_verb | _among(pb, lists.AUXILIARIES)).otherwise(F.lit(False)) if hinglish is not None else hindi_verb & ~pb.rlike("^(the|to|be|we|he|she|me|ye)$"))
    the_end = (pb == "the") & (~hinglish if hinglish is not None else F.lit(True))
    name = r"^[A-Z][a-z]+$"
    cost = (
        F.when(_among(pb, lists.BAD_LINE_ENDS) | the_end, 3.0)
        .when(_among(pb, lists.GENITIVES), 2.5)
        .when(pb.rlike(r"^\d[\d,.]*$") & ~nb.rlike(r"^\d"), 2.5)
        .when(p.rlike(name) & n.rlike(name), 2.0)
        .when(_among(nb, lists.CONJUNCTIONS), 0.25)
        .otherwise(1.0)
    )
    return (
        F.when((p == "") | (n == ""), 0.0)
        .when(n.rlike("^[।॥]") | _among(nb, lists.POSTPOSITIONS) | _among(nb, lists.AUXILIARIES) | the_verb, never)
        .when(is_sentence_end(p), 0.0)
        .when(p.rlike(r"""[,;:—–]["'»)\]”’]?$"""), 0.1)
        .otherwise(cost)
    )


def syllables(word: Column | str) -> Column:
    """Syllables of an English word by its vowels, silent endings left out; at least one."""
    w = F.regexp_replace(F.lower(_c(word)), "[^a-z]", "")
    core = F.regexp_replace(F.regexp_replace(w, "(?:[^laeiouy]es|[^laeiouy]e|ed)$", ""), "^y", "")
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(F.lit(1), F.regexp_count(core, F.lit("[aeiouy]{1,2}"))))


@F.pandas_udf(T.IntegerType())
def devanagari_syllables(word: pd.Series) -> pd.Series:
    """Vowels and vowel signs, and consonants with their own vowel; the last of these is silent in a longer word."""
    vowel, sign, consonant = r"[ऄ-औॠॡ]", r"[ा-ौॢॣ]", r"[क-हक़-य़]़*"
    unit = re.compile(f"{vowel}|{consonant}(?:{sign}|्)?|{sign}")

    def count(w: str) -> int:
        units = [u.group() for u in unit.finditer(w or "") if not u.group().endswith("्")]
        own = re.search(f"({consonant})[़ँ-ः]*$", w or "")
        silent = bool(own) and len(units) > 1
        return max(1, len(units) - silent)

    return word.map(count).astype("int32")


def onset_share(word: Column | str) -> Column:
    """Share of a word before its first vowel, weighed, at most 0.4."""
    w = F.lower(_c(word))
    at = F.regexp_instr(w, F.lit("[aeiouy]")) - 1
    return F.when(at <= 0, 0.0).otherwise(F.least(F.lit(0.4), at / F.greatest(F.lit(1), F.length(w)) * 0.6))


def salience(word: Column | str, place: Column, listed: Column | None = None, viral: list[str] | None = None) -> Column:
    """Additive weight of a word in its caption; 0 for glue words. ``listed``: the word is a keyword of the whole transcript."""
    w = _c(word)
    clean = F.regexp_replace(w, r"""^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$""", "")
    low, digit = F.lower(clean), w.rlike(r"\d")
    none = (clean == "") | (~digit & ((F.length(clean) < 3) | _among(low, lists.STOP) | _among(low, lists.LIGHT_WORDS)))
    score = F.lit(1.0) + F.least(F.lit(4.0), F.greatest(F.lit(0), F.length(clean) - 3) * 0.5)
    score = score + F.when(digit, 3.5).otherwise(0.0) + F.when(clean.rlike("^[A-Z][a-z]{2,}") & (place > 0), 2.5).otherwise(0.0) + F.when(_among(low, lists.CALLS), 2.0).otherwise(0.0)
    if viral:
        score = score + F.when(_among(low, viral), 2.5).otherwise(0.0)
    if listed is not None:
        score = score + F.when(listed, 3.0).otherwise(0.0)
    return F.when(none, 0.0).otherwise(score)


def keyword_flags(array: Column, mode: str = "smart", viral: list[str] | None = None) -> Column:
    """Which words of a caption stand out. mode: all, numbers, cta, names, keywords (the weightiest), smart (that, numbers and viral words)."""
    viral = viral or []
    clean = lambda w: F.regexp_replace(w, r"""^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$""", "")
    tests = {
        "all": lambda w, k: F.lit(True),
        "numbers": lambda w, k: w.rlike(r"\d"),
        "cta": lambda w, k: _among(F.lower(clean(w)), lists.CALLS),
        "names": lambda w, k: clean(w).rlike("^[A-Z][a-z]{2,}$") & (k > 0),
    }
    if mode in tests:
        return F.transform(array, tests[mode])
    scores = F.transform(array, lambda w, k: salience(w, k, viral=viral))
    top = F.when(F.array_max(scores) > 0, F.array_position(scores, F.array_max(scores)) - 1).otherwise(-1)
    pops = lambda w: w.rlike(r"\d") | (_among(F.lower(clean(w)), viral) if viral else F.lit(False))
    return F.transform(array, lambda w, k: (k == top) | (pops(w) if mode == "smart" else F.lit(False)))


def whole_phrase(flags: Column) -> Column:
    """All flags up if any is."""
    return F.transform(flags, lambda x: F.exists(flags, lambda y: y))


def mark_listed(array: Column, listed: Column) -> Column:
    """Which words are among the listed keywords (an array)."""
    return F.transform(array, lambda w: F.array_contains(listed, keyword(w)))


# ---- lines ---------------------------------------------------------------------------------


def clean_cue(text: Column | str) -> Column:
    """A cue without tags, inner times and positions."""
    t = F.regexp_replace(_c(text), r"(?i)</?[a-z][^>]*>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"<\d[\d:.,]*>", ""), r"\{\\[^}]*\}", "")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"^\s+|\s+$", "")


def is_non_speech(text: Column | str) -> Column:
    """What recognisers write over silence: a bracketed marker, at most one letter, or a stock line."""
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    stock = r"(?i)^(thanks for watching|thank you|please subscribe|subscribe|bye|you|okay|ok|so|the|♪+|music)\.?$"
    return (t == "") | t.rlike(r"^[\[(].*[\])]$") | (F.length(F.regexp_replace(t, r"[^A-Za-z0-9\x{0900}-\x{097F}]", "")) <= 1) | t.rlike(stock)


def speaker_of(text: Column | str) -> Column:
    """Struct of speaker and text of "Name: text" with a name of at most three words."""
    pattern = r"^\s*([A-Za-z][\w .'\-]{0,24}?)\s*[:：]\s+(.+)$"
    t = _c(text)
    name = F.trim(F.regexp_extract(t, pattern, 1))
    found = (name != "") & (F.regexp_extract(t, pattern, 2) != "") & (F.size(F.split(name, r"\s+")) <= 3)
    return F.struct(F.when(found, name).alias("speaker"), F.when(found, F.regexp_extract(t, pattern, 2)).otherwise(t).alias("text"))


_HOOKS = [
    ("opens on a question", 22), ("a bold claim", 18), ("a number", 10), ("talks to the viewer", 8), ("starts mid-thought", -25), ("", -20),
]


def _hook_tests(text: Column) -> list[Column]:
    t = F.trim(text)
    question = t.rlike(r"\?\s*$") | t.rlike(_pattern(lists.QUESTION_START, True)) | (t.rlike(_pattern(lists.HINDI_QUESTION)) & t.rlike(rf"(?i)(?:^|[^{LETTERS}])(?:{lists.HINDI_VERB_END})[\s,.!।]*$"))
    number = t.rlike(r"\d|[०-९]|%") | t.rlike(_pattern(lists.NUMBERS))
    return [question, t.rlike(_pattern(lists.STRONG)), number, t.rlike(_pattern(lists.YOU)), t.rlike(_pattern(lists.CONNECTIVE, True)), t.rlike(_pattern(lists.BACK_REFERENCE))]


def hook_score(text: Column | str) -> Column:
    """How well a line opens a clip: a sum of marks for and against."""
    return sum((F.when(test, weight).otherwise(0) for test, (_, weight) in zip(_hook_tests(_c(text)), _HOOKS, strict=True)), start=F.lit(0))


def hook_reasons(text: Column | str) -> Column:
    named = [F.when(test, F.lit(why)) for test, (why, _) in zip(_hook_tests(_c(text)), _HOOKS, strict=True) if why]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def hook_label(text: Column | str) -> Column:
    """Label of the first hook pattern that a line matches; null without one."""
    t = _c(text)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(label)) for p, label in lists.HOOK_PATTERNS])


def first_words(text: Column | str, n: int, all_up_to: int | None = None) -> Column:
    """The first words of a line, with an ellipsis where some are left out."""
    parts = F.filter(F.split(F.regexp_replace(_c(text), r"\s+", " "), " "), lambda w: w != "")
    whole = F.size(parts) <= (all_up_to or n)
    return F.when(whole, F.array_join(parts, " ")).otherwise(F.concat(F.array_join(F.slice(parts, 1, n), " "), F.lit("…")))


def title_of(line: Column | str) -> Column:
    """A title from a line: all of up to eight words, else six, without a comma at the end and with a capital; Clip for none."""
    parts = F.filter(F.split(F.regexp_replace(_c(line), '["“”]', ""), r"\s+"), lambda w: w != "")
    short = F.size(parts) <= 8
    t = F.regexp_replace(F.when(short, F.array_join(parts, " ")).otherwise(F.array_join(F.slice(parts, 1, 6), " ")), "[,;:–—-]+$", "")
    t = F.concat(t, F.when(short, F.lit("")).otherwise(F.lit("…")))
    return F.when(t == "", F.lit("Clip")).otherwise(F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30)))


def title_case(text: Column | str) -> Column:
    """Latin initials after spaces raised, the rest as it is."""
    parts = F.split(_c(text), " ")
    return F.array_join(F.transform(parts, lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))).otherwise(w)), " ")


def file_keywords(name: Column | str, most: int = 3) -> Column:
    """What a file's name says it shows: at most three words."""
    base = F.regexp_replace(F.element_at(F.split(_c(name), r"[\\/]"), -1), r"\.[^.]+$", "")
    parts = F.transform(F.split(F.regexp_replace(base, "([a-z])([A-Z])", "$1 $2"), r"[^A-Za-z0-9\x{0900}-\x{097F}]+"), file_word)
    return F.slice(F.array_distinct(F.filter(parts, lambda w: (w != "") & ~_among(w, lists.FILE_SKIP) & ~w.rlike(r"^\d+$"))), 1, most)


def same_stem(word: Column, key: Column) -> Column:
    """Equal, or one of five letters or more is the start of the other."""
    return (word != "") & (key != "") & ((word == key) | ((F.length(key) >= 5) & word.startswith(key)) | ((F.length(word) >= 5) & key.startswith(word)))


def emoji_for(text: Column | str, lexicon: list[tuple[str, str]]) -> Column:
    """The emoji of the first pattern of an ordered lexicon that the text matches."""
    t = _c(text)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(e)) for p, e in lexicon])


def enrich(text: Column | str, emoji: dict[str, str]) -> Column:
    """Each mapped Latin word followed by its emoji."""
    out = _c(text)
    for word, sign in emoji.items():
        out = F.regexp_replace(out, rf"(?i)(?<![A-Za-z])({re.escape(word)})(?![A-Za-z])", f"$1 {sign}")
    return out


def script_needs(text: Column | str) -> Column:
    return F.struct(_c(text).rlike("[A-Za-z]").alias("latin"), _c(text).rlike(r"[\x{0900}-\x{097F}]").alias("devanagari"))


def script_language(text: Column | str) -> Column:
    """hi for mostly Devanagari, hinglish for Latin with Hindi's everyday words, else null."""
    t = _c(text)
    deva, latin = F.regexp_count(t, F.lit(r"[\x{0900}-\x{097F}]")), F.regexp_count(t, F.lit("[A-Za-z]"))
    found = F.regexp_extract_all(F.lower(t), F.lit("([a-z]+)"), F.lit(1))
    hindi = F.size(F.filter(found, lambda w: _among(w, lists.HINDI_WORDS)))
    return F.when((deva > 20) & (deva > latin), F.lit("hi")).when((F.size(found) >= 8) & (hindi / F.size(found) >= 0.08), F.lit("hinglish"))


def probe_language(text: Column | str) -> Column:
    """hinglish where at least 15 % of the words are Latin beside Devanagari ones, deva where fewer are, null below three Devanagari words."""
    w = F.split(_c(text), r"\s+")
    is_deva = lambda x: x.rlike(r"[\x{0900}-\x{097F}]")
    deva = F.size(F.filter(w, is_deva))
    latin = F.size(F.filter(w, lambda x: ~is_deva(x) & x.rlike("[A-Za-z]{2,}")))
    return F.when(deva >= 3, F.when(latin / (deva + latin) >= 0.15, F.lit("hinglish")).otherwise(F.lit("deva")))


def is_hinglish(array: Column) -> Column:
    """Do the words of a text mix Hindi in: any Devanagari, or two Hindi words and at least six for ten English ones."""
    keys = F.transform(array, bare)
    hindi, english = F.size(F.filter(keys, lambda k: _among(k, lists.HINDI_MARKS))), F.size(F.filter(keys, lambda k: _among(k, lists.ENGLISH_MARKS)))
    return F.exists(array, lambda w: w.rlike(r"[\x{0900}-\x{097F}]")) | ((hindi >= 2) & (hindi >= english * 0.6))


def post_title(title: Column | str, most: int = 60) -> Column:
    """A title cut to ``most`` characters at a space."""
    t = F.trim(F.regexp_replace(_c(title), r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 3), r"\s+\S*$", ""), F.lit("…"))).otherwise(t)


def post_tags(tags: Column, most: int = 5) -> Column:
    """Distinct specific hashtags, whatever their case, in order."""
    clean = F.filter(F.transform(tags, lambda t: F.regexp_replace(_c(t), r"[^\w\x{0900}-\x{0963}\x{0966}-\x{097F}]", "")), lambda t: (t != "") & ~_among(F.lower(t), lists.GENERIC_TAGS))
    first = F.filter(clean, lambda t, k: F.array_position(F.transform(clean, F.lower), F.lower(t)) == k + 1)
    return F.transform(F.slice(first, 1, most), lambda t: F.concat(F.lit("#"), t))


def category(name: Column | str) -> Column:
    """The kind of a model's cut, whatever it was called."""
    key = F.regexp_replace(F.lower(F.trim(_c(name))), r"[\s\-]+", "_")
    out = F.lit("cut")
    for kind, names in lists.CATEGORIES.items():
        out = F.when(_among(key, names.split()), F.lit(kind)).otherwise(out)
    return out


def ass_text(text: Column | str) -> Column:
    """Text that a subtitle script takes as text: no braces or commands, breaks as \\N."""
    t = F.translate(_c(text), "{}", "()")
    return F.regexp_replace(F.regexp_replace(t, r"\\", "\\\\\\\\⁠"), r"\r?\n", r"\\\\N")


# ---- clusters and comparisons, as Arrow UDFs ------------------------------------------------


def clusters(text: str) -> list[str]:
    """User-perceived characters."""
    return regex.findall(r"\X", text or "")


def visible(text: str) -> float:
    """Width in letters: a Devanagari cluster counts 1.1."""
    if (text or "").isascii():
        return float(len(text or ""))
    return sum(1.1 if re.search("[ऀ-ॿ]", c) else 1.0 for c in clusters(text))


def visible_upto(text: str) -> list[float | None]:
    """Width of what stands before each place of a text, its end included; None inside a cluster."""
    if text.isascii():
        return [float(k) for k in range(len(text) + 1)]
    out: list[float | None] = [0.0]
    width = 0.0
    for c in clusters(text):
        width += 1.1 if re.search("[ऀ-ॿ]", c) else 1.0
        out += [None] * (len(c) - 1) + [width]
    return out


graphemes = F.pandas_udf(lambda s: s.map(clusters), T.ArrayType(T.StringType()))
visible_length = F.pandas_udf(lambda s: s.map(visible).astype(float), T.DoubleType())

# Devanagari letters and signs in Latin letters.
_CONSONANTS = dict(zip("क ख ग घ ङ च छ ज झ ञ ट ठ ड ढ ण त थ द ध न प फ ब भ म य र ल व श ष स ह ळ".split(), "k kh g gh ng ch chh j jh ny t th d dh n t th d dh n p ph b bh m y r l v sh sh s h l".split(), strict=True)) | dict(
    zip((unicodedata.normalize("NFC", x) for x in "क़ ख़ ग़ ज़ ड़ ढ़ फ़".split()), "q kh g z r rh f".split(), strict=True)
)
_VOWELS = dict(zip("अ आ इ ई उ ऊ ऋ ए ऐ ओ औ ऑ ॐ".split(), "a aa i ee u oo ri e ai o au o om".split(), strict=True))
_SIGNS = dict(zip(["ा", "ि", "ी", "ु", "ू", "ृ", "े", "ै", "ो", "ौ", "ॉ", "ॅ"], "aa i ee u oo ri e ai o au o e".split(), strict=True))
_OTHERS = {"ं": "n", "ँ": "n", "ः": "h", "।": ".", "॥": "."} | {chr(0x966 + k): str(k) for k in range(10)}


def latin(text: str) -> str:
    """Devanagari in Latin letters; a consonant's own vowel is written but at a word's end."""
    if not re.search("[ऀ-ॿ]", text or ""):
        return text
    text = unicodedata.normalize("NFC", text)
    syllable = re.compile("(?P<c>[क-हक़-य़]़?)(?P<m>[ा-ौॅॉ]|्)?(?P<on>(?=[ऀ-ॿ]))?|(?P<x>.)", re.DOTALL)

    def one(m: re.Match) -> str:
        if m["x"] is not None:
            return _VOWELS.get(m["x"]) or _OTHERS.get(m["x"], m["x"])
        base = _CONSONANTS.get(unicodedata.normalize("NFC", m["c"])) or _CONSONANTS.get(m["c"][0], m["c"])
        if m["m"]:
            return base + _SIGNS.get(m["m"], "")
        return base + ("a" if m["on"] is not None else "")

    return syllable.sub(one, text)


romanise = F.pandas_udf(lambda s: s.map(latin, na_action="ignore"), T.StringType())

# Sounds that a skeleton takes for one, in order.
_DEVA_SOUNDS = {c: s for s, group in (("k", "कखगघ"), ("n", "ङञणनंँ"), ("c", "चछजझ"), ("t", "टठडढतथदध"), ("p", "पफबभ"), ("m", "म"), ("r", "र"), ("l", "लळ"), ("w", "व"), ("s", "शषस")) for c in group}
_LATIN_SOUNDS = [
    (r"ow$", "o"), (r"ti(?=[aeiou])", "sh"), (r"ch", "C"), (r"c(?=[eiy])", "s"), (r"g(?=es?$)", "j"), (r"([ptkgdb])h", r"\1"), (r"sh", "s"), (r"ph", "p"),
    (r"[aeiouyh']", ""), (r"[cqgk]", "k"), (r"C", "c"), (r"[jz]", "c"), (r"d", "t"), (r"[bf]", "p"), (r"v", "w"), (r"x", "ks"),
]
_SKELETONS: dict[str, str] = {}


_LATIN_COMPILED = [(re.compile(pattern), sound) for pattern, sound in _LATIN_SOUNDS]


def skeleton(word: str) -> str:
    """Consonants of a word's sound, alike in Latin and Devanagari."""
    if word not in _SKELETONS:
        if re.search("[ऀ-ॿ]", word):
            s = "".join(_DEVA_SOUNDS.get(c, "") for c in unicodedata.normalize("NFD", word))
        else:
            s = word
            for pattern, sound in _LATIN_COMPILED:
                s = pattern.sub(sound, s)
        if len(_SKELETONS) > 100_000:
            _SKELETONS.clear()
        _SKELETONS[word] = re.sub(r"(.)\1+", r"\1", s.replace("m", "n"))
    return _SKELETONS[word]


sound_key = F.pandas_udf(lambda s: s.map(skeleton, na_action="ignore"), T.StringType())


_UNSPOKEN = regex.compile(r"[^\p{L}\p{M}\p{N}']")
_STRAIGHT = str.maketrans(dict.fromkeys(_CURLY, "'"))


@lru_cache(1 << 16)
def spoken_key(word: str) -> str:
    """As ``spoken``, with composition, of one word."""
    w = unicodedata.normalize("NFC", word or "").lower()
    w = w.translate(_STRAIGHT)
    return (w if w.isascii() and w.isalnum() else _UNSPOKEN.sub("", w)).strip("'")


@lru_cache(1 << 16)
def sound(word: str) -> str:
    """What words that sound the same share: a skeleton of three sounds or more, else the word."""
    bones = skeleton(word) if word else ""
    return f"~{bones}" if len(bones) >= 3 else word


def sounds_same(a: str, b: str) -> bool:
    """Equal words, or equal skeletons of three sounds or more."""
    return a == b or sound(a) == sound(b)


def edit_distance(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions and substitutions; most + 1 stands for more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def word_likeness(a: str, b: str) -> float:
    """2 the same word in any spelling, 1 nearly, 0.6 the same short word, 0.3 perhaps, -1.5 another."""
    if not a or not b:
        return -1.5
    if a == b:
        return 2.0
    if re.fullmatch(r"\d{2,}", a) and re.fullmatch(r"\d{2,}", b) and (a.endswith(b) or b.endswith(a)):
        return 0.6
    x, y = skeleton(a), skeleton(b)
    if not x and not y:
        return 0.3 if len(a) <= 4 and len(b) <= 4 else -1.5
    short = min(len(x), len(y))
    if x and y and x != y and short >= 4 and edit_distance(x, y) <= (2 if short >= 8 else 1):
        return 1.0
    if not x or x != y:
        return -1.5
    return 2.0 if len(x) >= 3 else 0.6


def fuzzy(text: str, query: str) -> int:
    """Score of a query's letters in order in a text: runs, word starts and an early first letter count more; -1 if they aren't all there."""
    text, query = (text or "").lower(), re.sub(r"\s+", "", (query or "").lower())
    if not query:
        return 0
    at, run, score, first = 0, 0, 0, None
    for letter in query:
        found = text.find(letter, at)
        if found < 0:
            return -1
        run = run + 1 if first is not None and found == at else 1
        first = found if first is None else first
        score += 1 + run + (4 if found == 0 or not re.match("[a-z0-9]", text[found - 1]) else 0)
        at = found + 1
    return score + max(0, 20 - first)


def fuzzy_score(query: str):
    """Column function of a text: its score for the query."""
    return F.pandas_udf(lambda s: s.map(lambda t: fuzzy(t, query)).astype("int32"), T.IntegerType())
