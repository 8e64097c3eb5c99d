"""Quality rules, lines first.

Every line with a word is held against the rules below; lines that fail are removed; a document that thereby
loses more than ``max_loss`` of its words is rejected.  A document also fails on two measures of its whole
text (too few words, too many words in repeated windows), whatever its lines say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweft.llm import lexical

SYMBOLS = b"#*$%&|<>"
_MARKED = re.compile(rb"[#*$%&|<>]|[!?]{2,}")
_SEPARATOR = re.compile(rb"(?:[|/>*\-]|\xc2\xbb|\xc2\xb7|\xe2\x80\xba|\xe2\x80\xa2)+")
_BOILERPLATE = re.compile(
    rb"all rights reserved|copyright (?:\(c\)|\xc2\xa9|[0-9])|licensed under|under the [a-z0-9 ]{2,40}licen[cs]e|(?:accept|uses?) cookies|cookie policy|privacy policy"
    rb"|terms of (?:use|service)|enable javascript|subscribe to our|sign up for|click here|read more|skip to (?:main )?content|lorem ipsum",
    re.IGNORECASE,
)
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xe2\x80\xa6", b"\xc2\xbb", b"\xe2\x80\x9d", b"\xe3\x80\x82")


@dataclass(frozen=True)
class LineRules:
    """Shares are of the line's words.  A short boilerplate phrase fails a line only up to ``boilerplate_words`` words."""

    marked: float = 0.3
    separators: float = 0.25
    stuttered: float = 0.5
    shouted: float = 0.8
    stub_words: int = 3
    boilerplate_words: int = 30

    def fault(self, line: bytes, seen: bool) -> str:
        """Why the line fails: punctuation, navigation or boilerplate; an empty string if it doesn't. ``seen``: an equal line came before."""
        words = line.split()
        n = len(words)
        if seen:
            return "boilerplate"
        if _MARKED.search(line):
            separators = sum(1 for w in words if _SEPARATOR.fullmatch(w))
            if n >= 3 and separators >= self.separators * n:
                return "navigation"
            if sum(1 for w in words if _MARKED.search(w)) > self.marked * n:
                return "punctuation"
        if n >= 6:
            if sum(a == b for a, b in zip(words, words[1:], strict=False)) >= self.stuttered * n:
                return "boilerplate"
            if line.isupper() and sum(w.isupper() for w in words) >= self.shouted * n:
                return "punctuation"
        elif n < self.stub_words and not words[-1].endswith(_ENDS):
            return "navigation"
        if n <= self.boilerplate_words and _BOILERPLATE.search(line):
            return "boilerplate"
        return ""


@dataclass(frozen=True)
class DocumentRules:
    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    max_loss: float = 0.5


def _measures(buf: np.ndarray, offsets: np.ndarray, rules: DocumentRules) -> tuple[np.ndarray, ...]:
    """n_words, word_chars, n_symbols and n_repeat_words of each text."""
    start, end, text = lexical.word_spans(buf, offsets)
    n = len(offsets) - 1
    n_words = np.bincount(text, minlength=n)
    chars = lexical.per_text(~lexical.SPACE[buf] & ~lexical.CONTINUES[buf], offsets)
    table = np.zeros(256, bool)
    table[list(SYMBOLS)] = True
    symbols = lexical.per_text(table[buf], offsets)
    hashes = lexical.span_hashes(lexical.prefix_sums(buf), start, end)
    at, h = lexical.windows(hashes, text, rules.repeat_window)
    order = np.lexsort((h, text[at]))
    same = (h[order][1:] == h[order][:-1]) & (text[at[order]][1:] == text[at[order]][:-1])
    found = np.zeros(len(at), bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    step = np.zeros(len(text) + 1, np.int64)
    np.add.at(step, at[found], 1)
    np.add.at(step, at[found] + rules.repeat_window, -1)
    covered = np.cumsum(step[:-1]) > 0
    return n_words, chars, symbols, np.bincount(text[covered], minlength=n)


def clean_lines(docs: DataFrame, lines: LineRules | None = None, rules: DocumentRules | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, the measures of its whole text, the verdict, and the text that is left.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_left,
    n_punctuation, n_navigation, n_boilerplate (lines removed), clean_text, and those of ``carry``.
    A null text is empty: it has no words, fails and is not kept; its clean_text is empty.  Lines without a word
    stay and count for nothing.  Repeated rows, null ids and other columns make no difference.
    """
    lines, rules = lines or LineRules(), rules or DocumentRules()
    held = docs.select("doc_id", "text", *[F.col(c).alias(f"_c_{c}") for c in carry])
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    after = ["words_left", "n_punctuation", "n_navigation", "n_boilerplate"]
    carried = [f for f in held.schema.fields if f.name.startswith("_c_")]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in numbers) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} long" for c in after) + ", clean_text string"
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo, hi, buf, offsets in lexical.batches(part.column("text")):
                n_words, chars, symbols, repeats = _measures(buf, offsets, rules)
                found: dict[str, list] = {c: [] for c in ["n_dup_lines", *after, "clean_text"]}
                raw = buf.tobytes()
                for k in range(hi - lo):
                    seen: set[bytes] = set()
                    left, faults, dup, words_left = [], {"punctuation": 0, "navigation": 0, "boilerplate": 0}, 0, 0
                    for line in raw[offsets[k] : offsets[k + 1]].split(b"\n"):
                        count = len(line.split())
                        if not count:
                            left.append(line)
                            continue
                        again = line in seen
                        dup += again
                        seen.add(line)
                        why = lines.fault(line, again)
                        if why:
                            faults[why] += 1
                        else:
                            left.append(line)
                            words_left += count
                    for name, value in (("n_dup_lines", dup), ("words_left", words_left), *((f"n_{w}", c) for w, c in faults.items()), ("clean_text", b"\n".join(left))):
                        found[name].append(value)
                base = (n_words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n_words)
                kept = ~base & (np.array(found["words_left"]) >= (1 - rules.max_loss) * n_words)
                cols = [part.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), *[pa.array(x.astype(np.int64)) for x in (n_words, chars, symbols)]]
                cols += [pa.array(found["n_dup_lines"], pa.int64()), pa.array(repeats.astype(np.int64)), pa.array(base), pa.array(kept)]
                cols += [pa.array(found[c], pa.int64()) for c in after] + [pa.array(found["clean_text"], pa.binary()).cast(pa.string())]
                cols += [part.column(f.name).slice(lo, hi - lo) for f in carried]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *numbers, "base_failed", "kept", *after, "clean_text", *[f.name for f in carried]])

    out = held.mapInArrow(run, schema)
    return out.withColumnsRenamed({f"_c_{c}": c for c in carry})
