"""Sentence units across languages and scripts (problem 2).

Candidate boundaries (ends of array elements, terminal marks with their closing
quotation marks, spaces between Thai letters) are classified by a maximum-entropy
model of the tokens around them: their text, case, length, digits, script, and
the mark. It is trained on reliable boundaries: those of arrays that split every
unmistakable boundary and that also show a careful splitter, by leaving a mark
before a capital unsplit or by splitting where a plain capital-letter rule can't.
Element ends of such arrays are positive, inner candidates negative examples.

What stands in brackets or quotation marks never ends a unit; headings, list
items, table rows, code segments and menu lines are units of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.maxent import MaxEnt, bounded_sample, fit, hashed

#: Bound of the labelled sample: chunks the model is trained on.
TRAINING_CHUNKS = 8000

_OPEN = {"(": ")", "[": "]", "（": "）", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "‹": "›", "《": "》"}
_WIDE = "぀-ヿ㐀-鿿豈-﫿＀-￯"
_MARK = re.compile("[.!?…。！？؟।॥;]+")
_CLOSERS = "\"'”’»)]」』）›》"
_CLOSERS_AND_GERMAN = tuple(_CLOSERS + "“")
_NO_SPACE = re.compile(f"(?:\\d+)?[{_WIDE}]")
_WIDE_CHAR = re.compile(f"[{_WIDE}]")
_THAI_GAP = re.compile("(?<=[฀-๿\"”)])[  ](?=[฀-๿\"“(A-Za-z])")
_LIST = re.compile(r"\s*(?:[-*•·]|\d{1,3}[.)])\s")
_TABLE = re.compile(r"[^|]*\|[^|]*\|")
_LINE_START = re.compile(r"(?<= )(?:\[CODE\]:|[-*•] |\d{1,2}[.)] (?=[A-Z])|© )")
#: Fixed value: abbreviations behind which even the plain splitter doesn't cut.
_PROTECTED = ("Mr", "Mrs", "Dr", "Prof", "Sr", "Jr", "vs", "etc", "e.g", "i.e")
_SOFT = 2.0  # log-odds from which a text without an array is cut where no mark stands
_CUT = -5.0  # log-odds above which a cut of the array before anything but a capital stands: plain splitters cut before capitals only
_RECURS = 3  # elements of the sample with one skeleton that make it a page line


def script(ch: str) -> str:
    """A letter's script or a character's kind, as one letter."""
    c = ord(ch)
    if ch.isdigit():
        return "0"
    if c < 0x250:
        return "A" if ch.isupper() else "a" if ch.isalpha() else ch
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "G" if ch.isupper() else "g" if ch.isalpha() else ch
    for name, low, high in (("r", 0x600, 0x6FF), ("h", 0x900, 0x97F), ("t", 0xE00, 0xE7F), ("k", 0x3040, 0x30FF), ("c", 0x3400, 0x9FFF)):
        if low <= c <= high:
            return name
    return "A" if ch.isupper() else "a" if ch.isalpha() else "p"


def shape(token: str) -> str:
    out: list[str] = []
    for ch in token[:24]:
        s = script(ch)
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _before(text: str, end: int) -> tuple[str, str]:
    """The last two tokens of ``text[:end]``; single characters in scripts without spaces."""
    part = text[max(0, end - 60) : end].rstrip()
    if part and _WIDE_CHAR.match(part[-1]):
        return part[-2:], part[-4:-2]
    words = part.rsplit(None, 2)
    return (words[-1][-20:] if words else ""), (words[-2][-20:] if len(words) > 1 else "")


def _after(text: str, start: int) -> tuple[str, str]:
    part = text[start : start + 60].lstrip()
    if part and _WIDE_CHAR.match(part[0]):
        return part[:2], part[2:4]
    words = part.split(None, 2)
    return (words[0][:20] if words else ""), (words[1][:20] if len(words) > 1 else "")


def features(prev2: str, prev: str, mark: str, gap: str, nxt: str, nxt2: str) -> list[str]:
    """What the model sees of one candidate."""
    low, ps, ns, p2s = prev.lower(), shape(prev), shape(nxt), shape(prev2)
    first = ns[:1]
    size = str(min(len(prev), 6))
    return [
        "b", "m" + mark, "g" + gap + first, "p" + low, "ps" + ps, "pl" + size, "n" + nxt.lower(), "ns" + ns,
        "pn" + low + "|" + first, "psn" + ps + size + "|" + ns + mark, "p2" + prev2.lower() + "|" + ps,
        "p2s" + p2s + "|" + ps + "|" + first, "mn" + mark + "|" + first,
        "n2" + nxt.lower() + "|" + shape(nxt2), "nx" + nxt[:2].lower() + gap,
    ]


def spans_of_quotes(text: str) -> list[tuple[int, int]]:
    """Outermost bracketed and quoted stretches, as (open, end); unmatched ones don't count."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    for m in re.finditer("[()\\[\\]（）「」『』“”„«»‹›《》\"]", text):
        ch, i = m.group(), m.start()
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == ch:
                if ch == '"' and i + 1 < len(text) and text[i - 1 : i].isspace() and not text[i + 1].isspace():
                    continue
                start = stack[depth][1]
                del stack[depth:]
                out = [s for s in out if s[0] < start]
                out.append((start, i + 1))
                break
        else:
            if ch in _OPEN:
                stack.append((_OPEN[ch], i))
            elif ch == '"' and i + 1 < len(text) and not text[i + 1].isspace():
                stack.append(('"', i))
    return out


def _inside(spans: list[tuple[int, int]], end: int) -> bool:
    """Whether a boundary at ``end`` would cut one of the stretches."""
    return any(a < end < b for a, b in spans)


def marks(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Candidates inside a text: (end of the mark with its closers, start of the mark, mark)."""
    closing = {b - 1 for _, b in spans}
    for m in _MARK.finditer(text):
        mark, start, end = m.group(), m.start(), m.end()
        if mark[0] == ";" and not (start and script(text[start - 1]) in "gG"):
            continue
        while end < len(text) and (text[end] in _CLOSERS or (text[end] == "“" and end in closing)):
            end += 1
        if end >= len(text):
            continue
        wide = mark[-1] in "。！？…"
        if text[end].isspace() or wide or (mark[0] in ".!?" and start and text[start - 1].isalpha() and _NO_SPACE.match(text, end)):
            yield end, start, mark


def is_line(element: str) -> bool:
    """List items, table rows and code segments: one unit, whatever they contain."""
    return element.startswith("[CODE]") or bool(_LIST.match(element) or (_TABLE.match(element) and " | " in element))


def context(text: str, end: int, start: int, mark: str) -> tuple[str, str, str, str, str, str]:
    prev, prev2 = _before(text, start)
    nxt, nxt2 = _after(text, end)
    gap = (text[start + len(mark) : end][:1] or "-") + ("_" if end < len(text) and text[end].isspace() else "")
    return prev2, prev, mark[:3], gap, nxt, nxt2


def _mark_at_end(element: str) -> tuple[int, str] | None:
    """Start and text of the terminal mark that ends an element, closers apart."""
    stem = element.rstrip(_CLOSERS + "“")
    m = re.search("[.!?…。！？؟।॥;]+$", stem)
    if not m or (m.group()[0] == ";" and not (m.start() and script(stem[m.start() - 1]) in "gG")):
        return None
    return m.start(), m.group()


def _easy(ctx: tuple[str, str, str, str, str, str]) -> bool:
    """An unmistakable boundary."""
    _, prev, mark, gap, nxt, _ = ctx
    nxt = nxt.lstrip("\"'“„«(¿¡")
    if gap[:1] in _CLOSERS_AND_GERMAN or not nxt or not (nxt[0].isupper() or script(nxt[0]) in "rhkc"):
        return False
    if mark in ("。", "।", "؟", "！", "？"):
        return True
    word = prev.strip("\"'“”«»()")
    return mark in (".", "!", "?") and len(word) >= 4 and word.isalpha() and word in (word.lower(), word.upper())


def skeleton(element: str) -> str:
    """An element without its figures and names, by which page lines recur."""
    return re.sub(r"\b[A-ZÀ-ÞΑ-Ω][\w'’-]*", "A", re.sub(r"\d[\d.,]*", "0", element))


def examples(sentences: list[str], recurring: frozenset[str] = frozenset()) -> list[tuple[tuple, bool]]:
    """Labelled candidates of a reliable array; none of any other array.

    Inside recurring page lines, which no splitter cuts, nothing is learned.
    """
    out: list[tuple[tuple, bool]] = []
    careful = False
    kinds = [is_line(s) for s in sentences]
    for k, s in enumerate(sentences):
        if kinds[k] or not s:
            continue
        quotes = spans_of_quotes(s)
        for end, start, mark in marks(s, quotes) if skeleton(s) not in recurring else ():
            if _inside(quotes, end):
                continue
            ctx = context(s, end, start, mark)
            if _easy(ctx):
                return []
            capital = ctx[4][:1].isupper()
            hard = len(ctx[1]) == 1 or "." in ctx[1] or (len(ctx[1]) <= 4 and ctx[1][:1].isupper())
            careful |= hard and capital and ctx[4][0] < "[" and ctx[3] == "-_" and ctx[1] not in _PROTECTED
            # behind closing quotation marks and long names an unsplit capital proves nothing
            if not capital or (ctx[3][0] == "-" and not (len(ctx[1]) >= 5 and ctx[1].isalpha())):
                out.append((ctx, False))
        if k + 1 < len(sentences) and sentences[k + 1] and not kinds[k + 1] and (m := _mark_at_end(s)):
            following = sentences[k + 1]
            ctx = context(s + " " + following[:60], len(s), m[0], m[1])
            careful |= _easy(ctx) and not ("A" <= following[0] <= "Z" or following[0] in "\"'(")
            out.append((ctx, True))
    return out if careful else []


def soft_contexts(text: str) -> Iterator[tuple[int, tuple]]:
    """Spaces before a capital that follow no mark: where an unmarked line may end."""
    for m in re.finditer(r"(?<=[^\s.!?,;:…]) (?=[A-ZÀ-ÞΑ-Ω\"“«(¿¡])", text):
        yield m.start(), context(text, m.start(), m.start(), "")


def soft_examples(sentences: list[str]) -> list[tuple[tuple, bool]]:
    out: list[tuple[tuple, bool]] = []
    for k, s in enumerate(sentences):
        if not s or is_line(s):
            continue
        out += [(ctx, False) for _, ctx in soft_contexts(s)]
        if k + 1 < len(sentences) and not _mark_at_end(s) and sentences[k + 1][:1].isupper():
            out.append((context(s + " " + sentences[k + 1][:60], len(s), len(s), ""), True))
    return out


def train(chunks: DataFrame, limit: int = TRAINING_CHUNKS) -> tuple[MaxEnt, MaxEnt]:
    """Fit both models on at most ``limit`` chunks, chosen by a hash of their id."""
    rows = chunks.where("chunk_id IS NOT NULL AND size(sentences) >= 3").select("chunk_id", "sentences")
    sample = bounded_sample(rows, "chunk_id", limit)
    return fit_on([[s or "" for s in row.sentences] for row in sample])


def fit_on(arrays: list[list[str]]) -> tuple[MaxEnt, MaxEnt]:
    """Fit the model of marked and that of unmarked boundaries on the reliable arrays.

    If all lines recur, they are learned from too. Without any reliable array
    the models know nothing, and only the fixed rules cut a text.
    """
    seen = Counter(skeleton(s) for a in arrays for s in a if s and not is_line(s))
    recurring = frozenset(k for k, n in seen.items() if n >= _RECURS)
    reliable = [(a, found) for a in arrays if (found := examples(a, recurring))]
    reliable = reliable or [(a, found) for a in arrays if (found := examples(a))]

    def fitted(rows: list[tuple[tuple, bool]]) -> MaxEnt:
        return fit([features(*c) for c, _ in rows], [y for _, y in rows])

    return fitted([x for _, found in reliable for x in found]), fitted([x for a, _ in reliable for x in soft_examples(a)])


class Splitter:
    """Applies the models; remembers the scores of contexts it has met."""

    def __init__(self, hard: list[float], soft: list[float]):
        self.weights = (hard, soft)
        self.known: tuple[dict, dict] = ({}, {})

    def _score(self, which: int, ctx: tuple) -> float:
        known = self.known[which]
        score = known.get(ctx)
        if score is None:
            if len(known) > 300_000:
                known.clear()
            w = self.weights[which]
            score = known[ctx] = sum(w[i] for i in hashed(features(*ctx)))
        return score

    def _ends(self, element: str, quotes: list[tuple[int, int]], shift: int) -> Iterator[int]:
        """Boundaries inside one prose element, as positions in it."""
        for end, start, mark in marks(element, [(a - shift, b - shift) for a, b in quotes]):
            if not _inside(quotes, end + shift) and self._score(0, context(element, end, start, mark)) > 0:
                yield end
        if re.search("[฀-๿]", element):
            for m in _THAI_GAP.finditer(element):
                if not _inside(quotes, m.start() + shift):
                    yield m.start()

    def _whole(self, text: str) -> list[int]:
        """Boundaries of a text without an array."""
        quotes = spans_of_quotes(text)
        starts = {m.start() - 1 for m in _LINE_START.finditer(text)}
        ends = set(self._ends(text, quotes, 0)) | {i for i in starts if not _inside(quotes, i)}
        ends |= {i for i, ctx in soft_contexts(text) if not _inside(quotes, i) and self._score(1, ctx) > _SOFT}
        return sorted(ends)

    def unit_ends(self, text: str, sentences: list[str] | None) -> list[int]:
        """Ends of the sentence units of a text, the last one at its end."""
        total = len(text)
        if not text.strip():
            return [total] if text else []
        if not sentences or " ".join(s or "" for s in sentences) != text:
            ends = self._whole(text)
        else:
            ends, parts = [], [s or "" for s in sentences]
            kinds = [is_line(s) for s in parts]
            quotes = spans_of_quotes(text)
            at = 0
            for k, s in enumerate(parts):
                stop = at + len(s)
                if not kinds[k]:
                    ends += [at + e for e in self._ends(s, quotes, at)]
                if s.strip() and (k + 1 == len(parts) or self._splits(text, s, stop, parts[k + 1], kinds[k] or kinds[k + 1], quotes)):
                    ends.append(stop)
                at = stop + 1
        clean: list[int] = []
        for e in sorted(set(ends)):
            while e > 0 and text[e - 1].isspace():
                e -= 1
            if e > (clean[-1] if clean else 0) and text[(clean[-1] if clean else 0) : e].strip():
                clean.append(e)
        if not clean or text[clean[-1] :].strip():
            clean.append(total)
        else:
            clean[-1] = total
        return clean

    def _splits(self, text: str, element: str, stop: int, following: str, line: bool, quotes) -> bool:
        """Whether the end of an array element ends a unit."""
        if line:
            return True
        if _inside(quotes, stop):
            return False
        end = _mark_at_end(element)
        if end is None or not following:
            return True
        joined = element[-120:] + " " + following[:60]
        cut = min(120, len(element))
        start = end[0] - (len(element) - cut)
        if start < 0:
            return True
        capital = following[0].isupper() or following[0] in "\"'(“«¿¡"
        return self._score(0, context(joined, cut, start, end[1])) > (0 if capital else _CUT)


def _unit_rows(hard: np.ndarray, soft: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(hard.tolist(), soft.tolist())
        for part in parts:
            ids, ends = [], []
            for i, text, sentences in zip(*(c.to_pylist() for c in part.columns), strict=True):
                found = splitter.unit_ends(text, sentences)
                ids += [i] * len(found)
                ends += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int32())], ["chunk_id", "end_pos"])

    return run


def sentence_units(chunks: DataFrame, training: DataFrame | None = None) -> DataFrame:
    """Ends of the sentence units of every text: ``chunk_id, end_pos INT``, each once.

    Null ids and null or empty texts have no unit; a text of white space is one.
    The model is fitted on ``training``, by default on the chunks themselves.
    """
    hard, soft = train(chunks if training is None else training)
    rows = chunks.where("chunk_id IS NOT NULL AND text <> ''").select("chunk_id", "text", "sentences")
    return rows.mapInArrow(_unit_rows(hard.weights, soft.weights), "chunk_id long, end_pos int").distinct()


def units_of(text: str, ends: list[int]) -> list[str]:
    """The unit strings that a list of ends cuts a text into."""
    return [text[a:b].strip() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
