"""Repeated takes of one recording, step by step in memory: what the joins have to give."""

from __future__ import annotations

from chronoweft.operators.takes import AGREE, BACK, EMPH, FILL, OPEN, SENTENCE, STRONG, WEAK, Phrase, _has_chat, _split_asides, carries_on, common, containment, is_prefix, is_remark, restarts, similarity, split_phrases
from chronoweft.functions.text import spoken_key


class Retakes:
    """One recording's phrases and what is cut of them."""

    def __init__(self, words: list[dict], sim: float = 0.6, min_run: int = 3, keep: str = "last", people: str | None = None, window: int = 16, max_gap: float = 60.0, contain: float = 0.85, pause: float = 0.45, aside_words: int = 8) -> None:
        self.sim, self.min_run, self.keep, self.people, self.window, self.max_gap, self.contain, self.aside_words = sim, max(2, min_run), keep, people, window, max_gap, contain, aside_words
        self.p = [Phrase(part) for ph in split_phrases(words, pause) for part in _split_asides(ph, aside_words)]
        if people == "one":
            for x in self.p:
                x.speaker = None
        self.gone: dict[int, str] = {}
        self.touched: set[int] = set()
        self.extra: list[dict] = []

    def same_speaker(self, a: Phrase, b: Phrase) -> bool:
        return a.speaker is None or b.speaker is None or a.speaker == b.speaker

    def strict(self, a: Phrase, b: Phrase) -> bool:
        """Several people, not told apart: only a close likeness counts."""
        return self.people == "many" and (a.speaker is None or b.speaker is None)

    def same_line(self, a: Phrase, b: Phrase) -> bool:
        """Can b be a said again by one person; every rule here says no."""
        if not self.same_speaker(a, b) or (a.asks and b.states) or (a.states and b.asks):
            return False
        if (a.you and not b.you and b.me) or (b.you and not a.you and a.me) or a.negative != b.negative:
            return False
        if (a.question and not b.question) or (b.question and not a.question and len(a.said) >= len(b.said)):
            return False
        reply = self.people != "one" and (a.speaker is None or b.speaker is None) and b.agrees and not a.agrees
        return not (reply and (self.people == "many" or a.states or not carries_on(a.said, b.said)))

    def alike(self, i: int, j: int) -> bool:
        a, b = self.p[i], self.p[j]
        if not a.said or not b.said or not restarts(a.said, b.said) or not self.same_line(a, b):
            return False
        strict, s = self.strict(a, b), similarity(a.said, b.said)
        if s >= (max(self.sim, 0.8) if strict else self.sim) and (s >= 0.75 or b.start - a.end <= 20):
            return True
        if strict or containment(a.said, b.said) < self.contain:
            return False
        grown = j - i <= 4 and len(a.said) <= len(b.said) and (not a.states or is_prefix(a.said, b.said))
        broken = j == i + 1 and len(b.said) < len(a.said) and not SENTENCE.search(b.last) and is_prefix(b.said, a.said)
        return grown or broken

    def groups(self) -> list[list[int]]:
        root = list(range(len(self.p)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, a in enumerate(self.p):
            if len(a.tokens) < self.min_run or a.nod:
                continue
            for j in range(i + 1, min(len(self.p), i + self.window + 1)):
                b = self.p[j]
                if b.start - a.end > self.max_gap:
                    break
                if len(b.tokens) >= min(self.min_run, 2) and not b.nod and self.alike(i, j):
                    root[find(i)] = find(j)
        found: dict[int, list[int]] = {}
        for i in range(len(self.p)):
            found.setdefault(find(i), []).append(i)
        return [g for g in found.values() if len(g) > 1]

    def kept(self, g: list[int]) -> int:
        """The take that stays: the last, the last complete one (best), or the surest (confident)."""
        if self.keep == "confident":
            known = [i for i in g if self.p[i].confidence is not None]
            return max(known, key=lambda i: (self.p[i].confidence, -i)) if known else g[-1]
        if self.keep != "best":
            return g[-1]
        most = max(len(self.p[i].said) for i in g)
        full = next(i for i in g if len(self.p[i].said) == most)
        for i in reversed(g):
            said = self.p[i].said
            if i != full and said and said[-1] in OPEN:
                continue
            ends = i != full and (self.p[i].states or self.p[i].asks) and said and said[-1] not in OPEN and not carries_on(said, self.p[full].said) and said[-1] in self.p[full].said
            if not most or len(said) >= 0.75 * most or (len(said) >= 0.5 * most and ends):
                return i
        return g[-1]

    def cut(self, i: int, why: str) -> None:
        self.gone[i] = why
        self.touched.add(i)

    def false_starts(self, most: int = 6) -> None:
        for i in range(len(self.p) - 1):
            a, b = self.p[i], self.p[i + 1]
            if i in self.gone or not 0 < len(a.said) <= most or a.nod or not self.same_line(a, b):
                continue
            if a.states and (self.strict(a, b) or len(a.said) == 1):
                continue
            if is_prefix(a.said, b.said):
                self.cut(i, "false start")

    def abandoned(self, gap: float = 90.0) -> None:
        """A take whose words a later stretch of phrases says again, though split otherwise."""
        n = len(self.p)
        for i, a in enumerate(self.p):
            if i in self.gone or a.nod or len(a.said) < 5:
                continue
            need = 0.82 if SENTENCE.search(a.last) else 0.75
            for j in range(i + 1, n):
                b = self.p[j]
                if b.start - a.end > max(self.max_gap, gap):
                    break
                if j in self.gone or not self.same_speaker(a, b) or (b.agrees and not a.agrees):
                    continue
                stream: list[str] = []
                k = j
                while k < n and len(stream) < len(a.said) * 1.6 + 4 and (k == j or self.p[k].start - self.p[k - 1].end <= 3):
                    stream += self.p[k].said
                    k += 1
                later = self.p[j:k]
                if len(stream) < len(a.said) or any(x.negative for x in later) != a.negative or (a.question and not any(x.question for x in later)) or (a.asks and not any(x.asks for x in later)):
                    continue
                if common(a.said, stream) / len(a.said) < need:
                    continue
                self.cut(i, "abandoned take")
                q = i - 1
                while q >= 0 and q not in self.gone and self.p[q + 1].start - self.p[q].end <= 6 and 1 <= len(self.p[q].said) <= 4 and 2 * common(self.p[q].said, stream) >= len(self.p[q].said):
                    self.cut(q, "false start")
                    q -= 1
                t = i + 1
                if t < n and t < j and t not in self.gone and 0 < len(self.p[t].said) <= 3 and self.p[t].start - a.end <= 1 and 2 * common(self.p[t].said, stream) <= len(self.p[t].said):
                    self.cut(t, "abandoned take")
                break

    def asides(self) -> None:
        """Short talk about the take itself beside a cut take."""
        for i, a in enumerate(self.p):
            if i in self.touched or i in self.gone or not 0 < len(a.tokens) <= self.aside_words:
                continue
            if not any(0 <= j < len(self.p) and j in self.touched and self.same_speaker(a, self.p[j]) for j in (i - 1, i + 1)):
                continue
            strong = sum(x in STRONG for x in a.tokens)
            weak = sum(x in WEAK and x not in STRONG for x in a.tokens)
            if (strong or _has_chat(a.tokens)) and (strong + weak) / len(a.tokens) >= 0.75:
                self.gone[i] = "off-script aside"

    def inner_restarts(self) -> None:
        """Words said twice in a row inside a phrase."""
        least = max(2, self.min_run - 1)
        for i, a in enumerate(self.p):
            if i in self.gone or (self.people == "many" and a.speaker is None) or any(w.get("estimated") for w in a.words):
                continue
            t = [(spoken_key(w["text"]), k) for k, w in enumerate(a.words)]
            t = [(x, k) for x, k in t if x and x not in FILL]
            at = 0
            while at < len(t):
                hit = 0
                for n in range(min(6, (len(t) - at - 1) // 2), least - 1, -1):
                    unit = [x for x, _ in t[at : at + n]]
                    if unit != [x for x, _ in t[at + n : at + 2 * n]] or len(set(unit)) < 2 or all(x in EMPH or x in AGREE or x in BACK for x in unit):
                        continue
                    if not is_remark(unit, a.words[t[at + n - 1][1]]["text"], a.words[t[at + 2 * n - 1][1]]["text"]):
                        hit = n
                        break
                if not hit:
                    at += 1
                    continue
                first, again = t[at][1], t[at + hit][1]
                if a.words[again]["start"] > a.words[first]["start"]:
                    self.extra.append({"start": a.words[first]["start"], "end": a.words[again]["start"], "text": " ".join(w["text"] for w in a.words[first:again]), "reason": "false start", "estimated": False})
                at += hit

    def run(self) -> list[dict]:
        for g in self.groups():
            stays = self.kept(g)
            self.touched.update(g)
            for i in g:
                if i != stays:
                    self.cut(i, "repeated take")
        self.false_starts()
        if self.people != "many":
            self.abandoned()
        self.asides()
        self.inner_restarts()
        out = list(self.extra)
        for i, why in self.gone.items():
            a, nxt = self.p[i], self.p[i + 1] if i + 1 < len(self.p) else None
            real = lambda w, side: not w.get("estimated") or bool(w.get(side))
            sure = real(a.words[0], "cue_start") and (real(nxt.words[0], "cue_start") if nxt else real(a.words[-1], "cue_end"))
            end = min(nxt.start if nxt else a.end, max(a.end, a.start) + 1.0)
            out.append({"start": a.start, "end": end, "text": a.text, "reason": why, "estimated": not sure})
        return tidy(out)


def tidy(cuts: list[dict], least: float = 0.1, slack: float = 0.05) -> list[dict]:
    """Cuts in order, joined where they touch; one guessed end makes the whole doubtful."""
    out: list[dict] = []
    for c in sorted(cuts, key=lambda c: c["start"]):
        if c["end"] - c["start"] < least:
            continue
        if out and c["start"] <= out[-1]["end"] + slack:
            o = out[-1]
            o["end"], o["estimated"] = max(o["end"], c["end"]), o["estimated"] or c["estimated"]
            if c["text"] and c["text"] not in o["text"].split(" / "):
                o["text"] += f" / {c['text']}"
        else:
            out.append(dict(c))
    return out
