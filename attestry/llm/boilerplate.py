"""Page boilerplate around the main content (problem 4).

Words get weights from labelled pages: positive where they speak for content,
negative where they speak for the page around it. The pages are labelled by
their own structure: a line whose form recurs, and recurs at the ends of chunks,
is page; forms that recur in the middle or only on top, and lines in the middle
that don't recur, are content. How often a form recurs, and where, is counted
over all chunks; only the lines that the model is fitted on are a bounded
sample. A maximum-entropy model of the words turns that into weights, and a
second round labels by places around the lines that the first one is sure of,
instead of by places in the chunk, counted over all chunks again.

A linear scan over a chunk's lines then finds the contiguous region of maximum
score, the main content. Lines outside it are page unless their own words speak
clearly for content; lines inside are content unless their own words speak
clearly for the page (an advertisement between two paragraphs).
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.maxent import SPACE, MaxEnt, bounded_sample, fit, hashed, list_rows
from attestry.llm.residue import residue_records

#: Bound of the labelled sample: chunks the weights are fitted on.
TRAINING_CHUNKS = 8000

_RECURS = 8  # lines of one form from which its places are trusted
_SURE = 3.0  # score from which a line is sure of being content
_OUTSIDE, _INSIDE = 1.0, -0.5  # content scores below which a line outside or inside the region is page
_LONG = 220  # characters of the longest lines that are trained on
_CAP = 6.0  # one line never weighs more than this in the region

_LISTED = re.compile(r"\s*(?:[-*•]|\d{1,3}[.)])\s")
_FIGURES = re.compile(r"\| *[\d.,]+ *(?:\||$)")
_GAPS = re.compile(r"\s+[|/>»·•–-]\s+|\s{2,}")
_NO_ITEM = re.compile(r"[\d.!?。！？।؟:]")
_SENTENCE_ENDS = ".!?。！？।؟:"  # of _NO_ITEM, those that most lines end in
_TOKEN = re.compile(r"\d[\d.,:]*|[^\W\d_]+|[^\w\s]")
_DENSE = re.compile("[฀-๿぀-ヿ㐀-鿿]")
_DIGITS = re.compile(r"\d[\d.,:]*")
_NAME = re.compile(r"\b[A-ZÀ-ÞΑ-Ω][\w'’-]*")


def is_article_line(line: str) -> bool:
    """Forms that only the article has: code segments, list items and rows of figures."""
    return line.startswith("[CODE]") or bool(
        _LISTED.match(line) or (line.count(" | ") >= 2 and _FIGURES.search(line))
    )


def _pieces(token: str) -> list[str]:
    if token[0].isdigit():
        return ["0"]
    return [token[i : i + 2] for i in range(max(1, len(token) - 1))] if _DENSE.match(token) else [token]


def _tokens(line: str) -> list[str]:
    return [p for t in _TOKEN.findall(line) for p in _pieces(t)]


def _is_menu(line: str) -> bool:
    """Short items without figures between separators or wide gaps."""
    if len(line) > 160 or line[-1:] in _SENTENCE_ENDS or _NO_ITEM.search(line):
        return False
    parts = _GAPS.split(line.strip())
    return len(parts) > 1 and all(0 < len(p) <= 24 for p in parts)


def features(line: str) -> list[str]:
    """Words of a line, its first and last ones, and its outer form."""
    raw = _tokens(line)
    words = [w.lower() for w in raw]
    if not words:
        return ["empty"]
    upper = line.isupper()
    names = ["A" if (w[0].isupper() and not upper and i) else lw for i, (w, lw) in enumerate(zip(raw, words, strict=True))]
    end = line.rstrip()[-1:]
    out = ["b", "end" + (end if not end.isalnum() else "w"), "size" + str(min(12, len(words).bit_length() * 2)),
           "first" + words[0], "first2" + " ".join(names[:2]), "first3" + " ".join(names[:3]),
           "last" + words[-1], "last2" + " ".join(names[-2:]), "last3" + " ".join(names[-3:]),
           "menu" if _is_menu(line) else "text"]
    out += {"w" + w for w in words}
    return out


def _is_dense(line: str) -> bool:
    return not line.isascii() and _DENSE.search(line) is not None


def line_ends(line: str) -> tuple[str, str]:
    """The keys by which a line's beginning and its end recur."""
    if _is_dense(line):
        plain = _plain(line)
        return "^" + plain[:4], "$" + plain[-5:]
    first, last = " ".join(line.split(None, 2)[:2]).lower(), " ".join(line.rsplit(None, 2)[-2:]).lower()
    return "^" + _DIGITS.sub("0", first), "$" + _DIGITS.sub("0", last)


def whole_form(line: str) -> str:
    """The key by which a whole line recurs, whatever its figures and names are."""
    plain = _plain(line)
    return "=" + (plain if _is_dense(line) else _NAME.sub("A", plain))


def _plain(line: str) -> str:
    return " ".join(_DIGITS.sub("0", line).split())


def places_in_chunk(page: list[str]) -> list[str]:
    """Of each line, whether it stands on top, in the middle or at the end; of fewer than four lines only that they are few."""
    n = len(page)
    return ["few"] * n if n < 4 else ["last" if i == n - 1 else "top" if i == 0 else "mid" for i in range(n)]


def places_around(page: list[str], score: Callable[[str], float]) -> list[str]:
    """Of each line, whether it stands before, among or after the lines sure of being content; nothing if none is."""
    n = len(page)
    first = next((i for i in range(n) if score(page[i]) > _SURE), None)
    if first is None:
        return []
    last = next(i for i in range(n - 1, first - 1, -1) if i == first or score(page[i]) > _SURE)
    return [
        "mid" if first < i < last else "last edge" if i == last else "edge" if i == first else "last" if i > last else "top"
        for i in range(n)
    ]


def count_places(
    pages: Iterable[list[str]], wanted: set[str], spots: Callable[[list[str]], list[str]]
) -> dict[str, Counter]:
    """How often each wanted form stands in which place, over all ``pages``.

    The forms are those of ``line_ends`` and ``whole_form``, put together from
    words, which are few: no figure, name or change of case goes beyond a word.
    """
    low = _Remembered(lambda word: _DIGITS.sub("0", word.lower())).__getitem__
    masked = _Remembered(lambda word: _NAME.sub("A", _DIGITS.sub("0", word))).__getitem__

    def shape(words: list[str]) -> tuple:
        """What lines of one whole form have in common and is quickly told."""
        return len(words), *map(masked, words[:2]), *map(masked, words[-1:])

    shapes = {shape(k[1:].split()) for k in wanted if k[0] == "="}
    seen: dict[tuple[str, str], int] = defaultdict(int)
    for page in pages:
        found = []
        for i, line in enumerate(page):
            if _is_dense(line):
                plain = _plain(line)
                keys = ["^" + plain[:4], "$" + plain[-5:]]
                if len(line) <= _LONG:
                    keys.append("=" + plain)
            else:
                words = line.split()
                keys = ["^" + " ".join(map(low, words[:2])), "$" + " ".join(map(low, words[-2:]))]
                # whole forms are made only where one is wanted that looks like the line
                if len(line) <= _LONG and shape(words) in shapes:
                    keys.append("=" + " ".join(map(masked, words)))
            found += [(key, i) for key in keys if key in wanted]
        if found:
            where = spots(page)
            if where:
                for key, i in found:
                    seen[key, where[i]] += 1
    places: dict[str, Counter] = defaultdict(Counter)
    for (key, where), n in seen.items():
        places[key][where] = n
    return places


def label_lines(
    pages: list[list[str]], keys: list[list[tuple[str, str, str] | None]], spots: list[list[str]],
    places: dict[str, Counter], around: bool = False,
) -> list[tuple[str, bool]]:
    """Lines labelled as content (True) or page (False); unclear lines are left out.

    ``keys`` are the forms of the lines (whole, beginning, end) that are trained on,
    ``spots`` their places and ``places`` how often each form stands in which place. Of a form's lines the shares on top, in
    the middle and at the end decide; with ``around`` that is before, among and
    after the lines sure of being content.
    """
    none: Counter = Counter()

    def times(key: str) -> int:
        seen = places.get(key, none)
        return sum(seen.values()) - seen["few"]

    def side(key: str, whole: bool = False) -> int:
        seen, n = places.get(key, none), times(key)
        if n < _RECURS:
            return 0
        last, among = (seen["last"] + seen["last edge"]) / n, seen["mid"] / n
        if around:
            edge = (seen["edge"] + seen["last edge"]) / n
            return 1 if among >= (0.2 if whole else 0.12) or last < 0.1 else -1 if among <= (0.12 if whole else 0.08) and (whole or edge < 0.5) else 0
        return -1 if last >= 0.16 and among <= 0.7 else 1 if last < 0.09 else 0

    out: list[tuple[str, bool]] = []
    for page, spot, page_keys in zip(pages, spots, keys, strict=True):
        for i, (line, line_keys) in enumerate(zip(page, page_keys, strict=True)):
            if line_keys is None:
                continue
            whole, begin, end = line_keys
            s = side(whole, True)
            if s == 0:
                sides = {side(begin), side(end)}
                s = -1 if -1 in sides and 1 not in sides else 1 if 1 in sides and -1 not in sides else 0
            # what doesn't recur and stands in the middle is content
            if s == 0 and times(whole) < _RECURS and len(page) >= 7 and 2 <= i < len(page) - 3 and (not around or (spot and spot[i] == "mid")):
                s = 1
            if s:
                out.append((line, s > 0))
    return out


def _fit(rows: list[tuple[str, bool]]) -> MaxEnt:
    # a line that recurs word for word teaches no more than a few copies of it
    kept = sorted(r for r, n in Counter(rows).items() for _ in range(min(n, 3 if r[1] else 12)))
    return fit([features(line) for line, _ in kept], [y for _, y in kept], epochs=4)


#: Counts the places of wanted forms, around lines sure of being content by the weights given, else in the chunk.
Count = Callable[[set[str], list[float] | None], dict[str, Counter]]


class _Around:
    """Places around sure lines by a model's weights, of pages met before."""

    def __init__(self, weights: list[float]):
        self.scorer, self.known = Scorer(weights), {}

    def meet(self, pages: list[list[str]]) -> None:
        self.known = self.scorer.scores(chain.from_iterable(pages))

    def __call__(self, page: list[str]) -> list[str]:
        return places_around(page, self.known.__getitem__)


def fit_on(pages: list[list[str]], count: Count | None = None) -> MaxEnt:
    """Weights from pages that label themselves; positive for content.

    ``count`` says how often forms recur in all pages, of which these may be a sample.
    """
    # whole paragraphs, and lines known by their form, needn't be learned
    keys = [[None if len(x) > _LONG or is_article_line(x) else (whole_form(x), *line_ends(x)) for x in page] for page in pages]
    wanted = {k for page in keys for line in page if line for k in line}
    model = None
    for _ in range(2):
        weights = None if model is None else model.table()
        spots = places_in_chunk
        if weights is not None:
            spots = _Around(weights)
            spots.meet(pages)
        places = count(wanted, weights) if count else count_places(pages, wanted, spots)
        model = _fit(label_lines(pages, keys, [spots(p) for p in pages], places, model is not None))
        # those that stand in fewer places altogether don't recur around sure lines either
        wanted = {k for k, seen in places.items() if sum(seen.values()) >= _RECURS}
    return model


def _count_rows(wanted: set[str], weights: list[float] | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = places_in_chunk if weights is None else _Around(weights)

        def pages() -> Iterator[list[str]]:
            for part in parts:
                batch = [[s or "" for s in lines] for lines in list_rows(part.column(0))]
                if weights is not None:
                    spots.meet(batch)
                yield from batch

        places = count_places(pages(), wanted, spots)
        found = [(key, where, n) for key, seen in places.items() for where, n in seen.items()]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["key", "spot", "n"])

    return run


def train(chunks: DataFrame, limit: int = TRAINING_CHUNKS) -> MaxEnt:
    """Fit on at most ``limit`` chunks, chosen by a hash of their id.

    The places of their lines' forms are counted over all chunks. A task sends the
    counts of its rows, at most five for each form of the sample; only their sums
    reach the driver. A chunk delivered twice counts twice there.
    """
    rows = chunks.where("chunk_id IS NOT NULL AND size(sentences) > 0").select("chunk_id", "sentences")
    sample = {row.chunk_id: row.sentences for row in bounded_sample(rows, "chunk_id", limit)}

    def count(wanted: set[str], weights: list[float] | None) -> dict[str, Counter]:
        parts = rows.select("sentences").mapInArrow(_count_rows(wanted, weights), "key string, spot string, n long")
        places: dict[str, Counter] = defaultdict(Counter)
        for key, spot, n in parts.groupBy("key", "spot").agg(F.sum("n").alias("n")).collect():
            places[key][spot] = n
        return places

    return fit_on([[s or "" for s in lines] for lines in sample.values()], count)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous region of maximum score; empty if none is positive."""
    best, at, start, total = 0.0, (0, 0), 0, 0.0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, at = total, (start, i + 1)
    return at


def page_lines(scores: list[float]) -> list[int]:
    """Numbers of the lines that belong to the page around the content."""
    start, end = best_region([max(-_CAP, min(_CAP, s)) for s in scores])
    return [i for i, s in enumerate(scores) if s < (_INSIDE if start <= i < end else _OUTSIDE)]


class _Remembered(dict):
    """A dictionary that finds what it lacks by a function, and keeps it."""

    def __init__(self, find: Callable):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        if len(self) > 500_000:
            self.clear()
        out = self[key] = self.find(key)
        return out


_BLOCK = 50_000  # lines that are scored at once
_WORD = crc32(b"w")
_LONGEST = 64  # bytes of the longest words whose checksums are put together


def _shifts() -> np.ndarray:
    """What each byte of a CRC-32 becomes when 0 to ``_LONGEST`` bytes follow: the sum (xor) over its four bytes is the whole's."""
    step = np.array([crc32(bytes([v])) ^ crc32(b"\0") for v in range(256)], np.uint32)
    out = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    tables = [np.stack(out)]
    for _ in range(_LONGEST):
        last = tables[-1]
        tables.append((last >> np.uint32(8)) ^ step[last & np.uint32(255)])
    return np.stack(tables)


_SHIFTS = _shifts()


def _followed(crc: np.ndarray, by: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of texts followed by others, of which the CRC-32 and the size are given."""
    byte = [_SHIFTS[size, k, (crc >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4)]
    return byte[0] ^ byte[1] ^ byte[2] ^ byte[3] ^ by


def _checksum(text: str) -> int:
    return crc32(text.encode("utf-8", "surrogatepass"))


class _Vocabulary(dict):
    """Numbers of the words between gaps, with the tokens of each, and of these the lower case, its checksum, size and weight."""

    def __init__(self, weights: list[float]):
        super().__init__()
        self.weights = weights
        self.start, self.count = array("q"), array("q")  # of a word's tokens
        self.low, self.upper = array("q"), array("b")  # of a token
        self.crc, self.size, self.weight = array("I"), array("q"), array("d")  # of a token in lower case
        self.numbers: dict[str, int] = {}  # of tokens in lower case
        self.name = self._number("A")

    def _number(self, low: str) -> int:
        out = self.numbers.get(low)
        if out is None:
            out, data = len(self.crc), low.encode("utf-8", "surrogatepass")
            self.numbers[low] = out
            self.crc.append(crc32(data))
            self.size.append(len(data))
            self.weight.append(self.weights[crc32(data, _WORD) % SPACE])
        return out

    def __missing__(self, word: str) -> int:
        tokens = [word] if word.isalpha() else _TOKEN.findall(word)
        self.start.append(len(self.low))
        self.count.append(len(tokens))
        for t in tokens:
            self.low.append(self._number("0" if t[0].isdigit() else t.lower()))
            self.upper.append(t[0].isupper())
        out = self[word] = len(self.start) - 1
        return out


class Scorer:
    """Content scores of lines; remembers the words and weights it has met."""

    def __init__(self, weights: list[float]):
        self.weights = weights
        self.weight = _Remembered(lambda feature: weights[hashed((feature,))[0]])
        self.word_weight = _Remembered(lambda word: weights[hashed(("w" + word,))[0]])
        self.word = _Remembered(lambda token: "0" if token[0].isdigit() else token.lower())
        self.end = _Remembered(lambda end: self.weight["end" + (end if not end.isalnum() else "w")])
        self.sizes = np.array([self.weight["size" + str(min(12, n.bit_length() * 2))] for n in range(64)])
        self.pieces = _Remembered(_pieces)
        self.table, self.vocabulary = np.array(weights), _Vocabulary(weights)

    def __call__(self, line: str) -> float:
        """The sum over ``features(line)``, with the work on known words saved."""
        if is_article_line(line):
            return 8.0
        raw = _TOKEN.findall(line)
        if not raw:
            return self.weight["empty"]
        if _is_dense(line):
            raw = _tokens(line)
        word, upper, n = self.word.__getitem__, line.isupper(), len(raw)
        name = lambda t: word(t) if upper or not t[0].isupper() else "A"
        first, last = word(raw[0]), word(raw[-1])
        head, tail = [first, *map(name, raw[1:3])], list(map(name, raw[-3:]))
        if n <= 3:
            tail[0] = first
        end = line.rstrip()[-1:]
        total = sum(map(self.word_weight.__getitem__, set(map(word, raw))))
        total += self.weight["b"] + self.end[end] + float(self.sizes[min(n, 63)]) + self.weight["menu" if _is_menu(line) else "text"]
        edges = ("first", first), ("first2", " ".join(head[:2])), ("first3", " ".join(head)), ("last", last), ("last2", " ".join(tail[-2:])), ("last3", " ".join(tail))
        return total + sum([self.weights[_checksum(kind + x) % SPACE] for kind, x in edges])

    def scores(self, lines: Iterable[str]) -> dict[str, float]:
        """The scores of many lines, by line.

        Lines become numbers of the words between gaps, or of tokens in scripts
        without spaces, and all else is done on arrays: a feature's checksum is put
        together from its words'.
        """
        out: dict[str, float] = {}
        once = [*{*lines}]
        for start in range(0, len(once), _BLOCK):
            self._score_block(once[start : start + _BLOCK], out)
        return out

    def _score_block(self, lines: list[str], out: dict[str, float]) -> None:
        if len(self.vocabulary) > 500_000:
            self.vocabulary = _Vocabulary(self.weights)
        known, words, sizes, rest, upper = [], [], [], [], []
        menu, text = self.weight["menu"], self.weight["text"]
        for line in lines:
            if is_article_line(line):
                out[line] = 8.0
                continue
            found = [*chain.from_iterable(map(self.pieces.__getitem__, _TOKEN.findall(line)))] if _is_dense(line) else line.split()
            if not found:
                out[line] = self.weight["empty"]
                continue
            known.append(line)
            words += found
            sizes.append(len(found))
            rest.append(self.end[line.rstrip()[-1:]] + (menu if _is_menu(line) else text))
            upper.append(line.isupper())
        if known:
            total, sure = self._totals(np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words)), np.array(sizes), np.array(upper))
            total += np.array(rest)
            out.update(zip(known, total.tolist(), strict=True))
            for i in np.flatnonzero(~sure).tolist():
                out[known[i]] = self(known[i])

    def _totals(self, words: np.ndarray, sizes: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of lines, given by the numbers of their words, the sums of all features but their end and menu; and which are valid.

        They aren't without tokens, or if a word at an edge is longer than ``_LONGEST``.
        """
        v = self.vocabulary
        start, count, low, name = np.array(v.start), np.array(v.count), np.array(v.low), np.array(v.upper, bool)
        crc, size, weight = np.array(v.crc, np.uint32), np.array(v.size), np.array(v.weight)
        tokens = count[words]
        slot = np.repeat(start[words] - (np.cumsum(tokens) - tokens), tokens) + np.arange(tokens.sum())
        token, name = low[slot], name[slot]
        n = np.add.reduceat(tokens, np.cumsum(sizes) - sizes)
        stop = np.cumsum(n)
        # each word of a line once
        pair = np.sort((np.repeat(np.arange(len(n)), n) << 32) | token)
        pair = pair[np.diff(pair, prepend=-1) != 0]
        total = np.bincount(pair >> 32, weight[pair & 0xFFFFFFFF], len(n)) + self.weight["b"] + self.sizes[np.minimum(n, 63)]
        some = n > 0
        if not some.any():
            return total, some
        token_or_name = np.where(name & ~np.repeat(upper, n), v.name, token)
        at = lambda of, i: of[np.clip(i, 0, len(of) - 1)]
        first, last = at(token, stop - n), at(token, stop - 1)
        head = [first, at(token_or_name, stop - n + 1), at(token_or_name, stop - n + 2)]
        tail = [np.where(n <= i, first, at(token_or_name, stop - i)) for i in (3, 2, 1)]
        sure = some & (np.max([size[x] for x in (*head, *tail, last)], axis=0) <= _LONGEST)
        fits = np.minimum(size, _LONGEST)
        space = np.uint32(crc32(b" "))

        def edge(kind: bytes, parts: list[np.ndarray], used: list[np.ndarray | bool]) -> np.ndarray:
            out, begun = np.full(len(n), crc32(kind), np.uint32), np.zeros(len(n), bool)
            for part, use in zip(parts, used, strict=True):
                longer = np.where(begun, _followed(out, space, np.ones(len(n), np.int64)), out)
                out = np.where(use, _followed(longer, crc[part], fits[part]), out)
                begun |= use
            return self.table[out % np.uint32(SPACE)]

        total += edge(b"first", [first], [True]) + edge(b"last", [last], [True])
        total += edge(b"first2", head[:2], [True, n > 1]) + edge(b"first3", head, [True, n > 1, n > 2])
        total += edge(b"last2", tail[1:], [n > 1, True]) + edge(b"last3", tail, [n > 2, n > 1, True])
        return total, sure


def _page_rows(weights: np.ndarray):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights.tolist())
        for part in parts:
            ids, numbers, pages = [], [], [[s or "" for s in lines] for lines in list_rows(part.column(1))]
            known = scorer.scores(chain.from_iterable(pages))
            for i, page in zip(part.column(0).to_pylist(), pages, strict=True):
                found = page_lines([known[s] for s in page])
                ids += [i] * len(found)
                numbers += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())], ["chunk_id", "sentence_no"])

    return run


def page_elements(chunks: DataFrame, training: DataFrame | None = None, residue: DataFrame | None = None) -> DataFrame:
    """Elements that belong to the page around the article: ``chunk_id, sentence_no INT``.

    Each once, however often a chunk is delivered. Null ids, null and empty
    arrays have none; records of residue (problem 3) contribute none. Their ids
    can be given as ``residue``, so that they needn't be found again.
    """
    model = train(chunks if training is None else training)
    rows = chunks.where("chunk_id IS NOT NULL AND size(sentences) > 0").select("chunk_id", "sentences")
    found = rows.mapInArrow(_page_rows(model.weights), "chunk_id long, sentence_no int")
    return found.join(residue_records(chunks) if residue is None else residue.select("chunk_id"), "chunk_id", "left_anti").distinct()


def main_content(chunks: DataFrame) -> DataFrame:
    """``chunk_id, sentences, text`` with only the main body of every chunk."""
    found = page_elements(chunks).groupBy("chunk_id").agg(F.collect_set("sentence_no").alias("drop_no"))
    once = chunks.select("chunk_id", "sentences", "text").dropDuplicates(["chunk_id"])
    kept = F.filter("sentences", lambda s, i: ~F.array_contains("drop_no", i))
    changed = F.col("drop_no").isNotNull()
    return (
        once.join(found, "chunk_id", "left")
        .withColumn("sentences", F.when(changed, kept).otherwise(F.col("sentences")))
        .select(
            "chunk_id", "sentences",
            F.when(changed, F.array_join("sentences", " ")).otherwise(F.col("text")).alias("text"),
        )
    )
