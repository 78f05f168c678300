"""Sentence units in many languages by a semi-Markov dynamic programme.

Stops, and in Thai the spaces between letters, give the places where a unit may end. Every span
between two such places is a possible sentence. Its score is the sum of how well its first word
opens a sentence, how well its last word and stop close one, how likely its length is in its
script, and a penalty where it cuts a quotation. The chain of spans with the largest sum is found
from left to right over all spans, starts that can never win again being left out.

The weights of words come from the corpus (``learn``): a word opens well if it stands after sure
ends, and not elsewhere, more often than the words of its letter case do; a word before a full stop closes as often
as what follows it opens (expectation maximisation over both, the fixed lists being priors); a
single letter is a label if it stands without a stop after the word before it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.session import bounded_rows, spread, stage

# Stops, quotes and words that tell about sentence ends before the corpus does.
CASELESS_STOPS = "。！？｡．。।॥؟۔"
QUOTE_PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "", "「": "」", "『": "』", "‹": "›", "《": "》", "‚": "‘"}
#: Words whose full stop does not end a sentence.
NEVER = set(
    """dr prof mr mrs ms st sr sra dra hr fr mme mlle jr hrn frl fig figs tab tabl табл рис см sec nr núm pág págs vol vols pp p ref refs vgl cf approx aprox
    env ca vs sp spp subsp var bzgl bzw проф доц акад г гг стр с т डॉ प्रो श्री د أ م أد abb kap ch chap eq eqs art ed eds viz resp inkl zzgl ggf evtl sog
    geb max min ib ibid op cit lic ing gen col capt lt sgt rev hon gov pres univ dept esp ex ej""".split()
)
#: Words whose full stop may also end the sentence, if the next word can open one.
EITHER = set("usw etc إلخ al др пр д inc co corp ltd jr bros f ff a u ä o seq".split())
#: Small letters that are parts of abbreviations.
SINGLE = set("a b c d e f g h i j n o p s u v z т е к н э".split())
#: Abbreviations only before a number.
BEFORE_NUMBER = set("no nos nr núm n art abs § s z".split())
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jan feb mär mar apr jun jul aug sep sept okt oct nov dez dec jänner".split())
#: Before a number with a full stop that counts things.
BEFORE_ORDINAL = set("die der das den dem des am im zum zur beim vom ins jede jeder jedes dieser diese dieses".split())
#: A single letter after one of these is a label, not an initial.
LABELLED = set("chain form site type group class form plan case vitamin figure table part kette gruppe typ chaîne groupe cadena grupo tipo цепь группа тип".split())
OPENING_MARKS = "([{“„«‹\"'¿¡「『（【《〈‘"
#: After a closing bracket or quote of these scripts a particle goes on with the sentence.
PARTICLES = "とはがをにでもへやのなか而"

#: Log odds that a unit ends with a word and its stop, before the corpus is asked.
SURE, WORD, WORD_OR_QUOTE, MAYBE, DOTTED, ABBREVIATION = 9.0, 7.5, 2.0, 2.0, -6.0, -8.0
#: Log odds of the first letter of what follows.
CAPITAL, SMALL, BRACKET = 1.0, -4.0, -2.0
#: Cutting a quotation, from each side; a quotation alone as a span where its sentence seems to go on; a quotation mark without its partner.
UNBALANCED, CARRIED, STRAY = -12.0, -14.0, -20.0
#: What one unit of log length, in spreads of its script, counts.
LENGTH_WEIGHT = 0.4
#: (log of the usual length, mean deviation from it) before the corpus is asked.
LENGTHS = {"cased": (math.log(100), 0.5), "han": (math.log(30), 0.5), "thai": (math.log(40), 0.5), "other": (math.log(70), 0.5)}

_BLANK_LINE = re.compile(r"(?:\r\n|\r|\n)(?:[^\S\r\n]*(?:\r\n|\r|\n))+")
_MARK = r"(?:\s?\[\d{1,4}(?:\s?[,;–-]\s?\d{1,4})*\])"
_CLOSER = r"(?:[”’')\]}」』）】》〉›»]|\"(?![^\W\d_])|“(?=[\s,;:.!?…)\]]|$)|[   ]{1,2}[»›])"
_PLACE = re.compile(rf"([.!?…‥{CASELESS_STOPS}]+)({_CLOSER}*)({_MARK}*)({_CLOSER}*)|(?<=[ก-๛])[^\S\r\n]+(?=[ก-๛])")
_QUOTE = re.compile("[\"“”„«»「」『』‹›《》‚‘]")
_BRACKET = re.compile(r"[()（）\[\]]")
_CLOSE_SCRIPTS = r"\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
_OPENER = re.compile(rf"[^\W\d_{_CLOSE_SCRIPTS}][^\s!-/:-@\[-`{{-~“”„«»।॥…،؛؟\u3001-\u3011\uff00-\uff65{_CLOSE_SCRIPTS}]*")


@dataclass
class Lexicon:
    """What the corpus says: log odds by word, and (log of the usual length, mean deviation) by script."""

    opens: dict[str, float] = field(default_factory=dict)
    closes: dict[str, float] = field(default_factory=dict)
    labels: dict[str, float] = field(default_factory=dict)
    lengths: dict[str, tuple[float, float]] = field(default_factory=lambda: dict(LENGTHS))


NOTHING = Lexicon()


def _cased(c: str) -> bool:
    return c.lower() != c.upper()


def script(text: str) -> str:
    """The kind of script of the first letter."""
    for c in text:
        if c.isalpha():
            if "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff":
                return "han"
            return "thai" if "\u0e00" <= c <= "\u0e7f" else "cased" if _cased(c) else "other"
    return "cased"


def quotations(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """(opening, closing) places of the quotations, and the openings that nothing closes."""
    found: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    straight: int | None = None
    for m in _QUOTE.finditer(text):
        i, c = m.start(), m[0]
        if c == '"':
            if straight is None:
                straight = i
            else:
                found.append((straight, i))
                straight = None
            continue
        if stack and c in QUOTE_PAIRS[stack[-1][0]]:
            found.append((stack.pop()[1], i))
        elif QUOTE_PAIRS.get(c):
            stack.append((c, i))
    found.sort()
    return found, sorted([i for _, i in stack] + ([straight] if straight is not None else []))


def _word_before(text: str, at: int, block: int) -> str:
    """The word that ends before ``at``, white space between them aside."""
    b = at
    while b > block and text[b - 1].isspace():
        b -= 1
    a = b
    while a > block and not text[a - 1].isspace():
        a -= 1
    return text[a:b]


class _Block:
    """A stretch of text without blank lines, and where its brackets open."""

    def __init__(self, text: str, start: int, end: int, lexicon: Lexicon):
        self.text, self.start, self.end, self.lexicon = text, start, end, lexicon
        self._brackets: dict[int, int] | None = None

    def own_bracket(self, end: int) -> bool:
        """Whether the bracket that closes last before ``end`` holds a sentence of its own."""
        text = self.text
        if self._brackets is None:
            self._brackets, stack = {}, []
            for m in _BRACKET.finditer(text, self.start, self.end):
                if m[0] in "(（[":
                    stack.append(m.start())
                elif stack:
                    self._brackets[m.start()] = stack.pop()
        i = end - 1
        while i > self.start and text[i] not in ")）]":
            i -= 1
        at = self._brackets.get(i)
        if at is None:
            return False
        while at > self.start and text[at - 1].isspace():
            at -= 1
        return at == self.start or text[at - 1] in ".!?…\"”»)]" + CASELESS_STOPS

    def opening(self, at: int) -> float:
        """How well what stands at ``at`` opens a sentence."""
        c = self.text[at]
        if c.isalpha():
            m = _OPENER.match(self.text, at)
            learned = self.lexicon.opens.get(m[0], 0.0) if m else 0.0
            return (SMALL if c.islower() else CAPITAL) + learned
        if c == "(" and not self.text[at + 1 : at + 2].isupper():
            return BRACKET
        return CAPITAL if c.isdigit() or c in OPENING_MARKS or not c.isascii() else SMALL

    def label(self, at: int) -> float:
        """Whether the word before the single letter at ``at`` says that it is a label or, being a number, a unit."""
        word = _word_before(self.text, at, self.start).strip("\"“(«„").lower()
        if word[-1:].isdigit() and word.replace(".", "").replace(",", "").isdigit():
            return WORD
        return self.lexicon.labels.get(word, WORD if word in LABELLED else ABBREVIATION)

    def place(self, m: re.Match) -> tuple[float, float] | None:
        """(closing, opening) scores of a cut after ``m``, or None where no unit can end."""
        text = self.text
        if m[1] is None:  # a space in Thai
            return SURE, 0.0
        end, stops = m.end(), m[1]
        gap = end
        while text[gap].isspace():
            gap += 1
        first = text[gap]
        closers = m[2] + m[4]
        quoted = any(c in "\"”’'」』›»“" for c in closers)
        if any(c in CASELESS_STOPS for c in stops):
            if stops == "．" and first.isdigit() or first in "，、；：,;:)）」』”" or quoted and gap == end and first in PARTICLES:
                return None
            return WORD_OR_QUOTE if quoted else SURE, self.opening(gap)
        if "…" in stops or "‥" in stops or ".." in stops:
            return None if first.islower() or first in ",;:)）」』”" else (WORD - 1, self.opening(gap))
        if "!" in stops or "?" in stops:
            if first in ",;:–—、，" or quoted and gap == end and first in PARTICLES:
                return None
            split = quoted or closers and not self.own_bracket(end)
            return WORD_OR_QUOTE if split else WORD, self.opening(gap)
        return self._full_stop(m.start(), end, gap)

    def _full_stop(self, at_stop: int, end: int, gap: int) -> tuple[float, float] | None:
        text, first = self.text, self.text[gap]
        joined = gap == end  # nothing between the stop and what follows
        if first in ",;:)]}–—" or joined and (first in ".!?…-/'’" or first.isdigit() and text[at_stop - 1 : at_stop].isdigit()):
            return None
        closed = end > at_stop + 1
        if closed:
            inner = text[at_stop + 1 : end]
            own = not joined and ("[" in inner or any(c in inner for c in ")）]") and self.own_bracket(end))
            return WORD if own else WORD_OR_QUOTE, self.opening(gap)
        if joined and first.islower():
            return None
        at = at_stop
        while at > self.start and not text[at - 1].isspace() and text[at - 1] not in "!?…" and text[at - 1] not in CASELESS_STOPS:
            at -= 1
        token = text[at:at_stop].lstrip(OPENING_MARKS)
        word = token.lower()
        if joined:
            after = text[gap + 1 : gap + 2]
            if len(token) == 1:
                return (self.label(at), self.opening(gap)) if first.isupper() and after.islower() else None
            if "." in token or word in NEVER:
                return None
            if first.isupper():
                starts = after.islower() or after.isspace() or after.isupper() and len(token) > 2 and token[-1].islower()
                return (WORD, self.opening(gap)) if starts else None
            return MAYBE, self.opening(gap)
        if token[-1:] in ")]}»”\"’）":  # a bracket or quotation that ended before the stop
            return WORD, self.opening(gap)
        opens = self.opening(gap)
        if len(token) == 1 and token.isalpha():
            if token.isupper():
                return self.label(at), opens
            if not _cased(word) or word not in EITHER and (word in NEVER or word in SINGLE):
                return ABBREVIATION, opens
            return MAYBE, opens
        if word == "al" and first == "(":
            return ABBREVIATION, opens
        if word in BEFORE_NUMBER and (first.isdigit() or first in "IVX"):
            return ABBREVIATION, opens
        if word in MONTHS and _word_before(text, at, self.start)[-1:].isdigit():
            return ABBREVIATION, opens
        if token.isdigit():
            counted = len(token) <= 2 and (m := _OPENER.match(text, gap)) and m[0].lower() in MONTHS
            if at == self.start or counted or len(token) <= 3 and _word_before(text, at, self.start).lower() in BEFORE_ORDINAL:
                return ABBREVIATION, opens
            return WORD, opens
        return self.lexicon.closes.get(word, prior(word)[0]), opens


def prior(word: str) -> tuple[float, float]:
    """(log odds, strength in occurrences) that a full stop after ``word`` ends a unit."""
    if word in EITHER:
        return MAYBE, 20.0
    if word in NEVER:
        return ABBREVIATION, 50.0
    if "." in word and any(c.isalpha() for c in word) and not any(c.isdigit() for c in word):
        return DOTTED, 20.0
    return WORD, 25.0


def best_chain(
    at: list[int], close: list[float], opens: list[float], inside: list[bool], alone: dict[int, int], usual: float, slope: float, open_end: bool
) -> tuple[float, list[int]]:
    """(score, cuts) of the best chain of spans over the places ``at``, first and last included.

    A span from i to j scores opens[i] + close[j], less ``slope`` for each unit of log length
    away from ``usual``, UNBALANCED if either end lies inside a quotation and CARRIED if
    ``alone[j]`` is i; a last span that the text's end cuts off (``open_end``) isn't held to be
    short. Beyond the usual length a start loses for good against a later one with a better sum,
    and against an earlier one that is as good now, as the lengths grow alike: such starts are
    left out, and nothing else is. A start that CARRIED still waits for defeats no other.
    """
    n = len(at)
    reach = math.exp(usual)
    total, back = [0.0] * n, [0] * n
    worth = [0.0] * n  # of the best chain to a place and the opening there
    near: list[int] = [0]
    far: tuple[list[int], list[int]] = ([], [])
    log = math.log
    worth[0] = opens[0]
    until = {i: j for j, i in alone.items()}
    for j in range(1, n):
        here = at[j]
        k = 0
        while k < len(near) and here - at[near[k]] >= reach:
            i = near[k]
            k += 1
            held = far[inside[i]]
            while held and worth[held[-1]] <= worth[i] and until.get(i, 0) < j:
                held.pop()
            held.append(i)
        if k:
            del near[:k]
        best, by = -math.inf, 0
        marked = alone.get(j, -1)
        for i in near:
            s = worth[i]
            if not (open_end and j == n - 1):
                s -= slope * abs(log(here - at[i]) - usual)
            if inside[i] or inside[j]:
                s += UNBALANCED
            if i == marked:
                s += CARRIED
            if s > best:
                best, by = s, i
        for held in far:
            top, kept = -math.inf, 0
            for i in held:
                s = worth[i] - slope * (log(here - at[i]) - usual)
                if s > top:
                    if until.get(i, 0) < j:
                        top = s
                    held[kept] = i
                    kept += 1
                    if inside[i] or inside[j]:
                        s += UNBALANCED
                    if i == marked:
                        s += CARRIED
                    if s > best:
                        best, by = s, i
            del held[kept:]
        total[j], back[j] = best + close[j], by
        worth[j] = total[j] + opens[j]
        near.append(j)
    cuts, j = [], n - 1
    while j:
        j = back[j]
        if j:
            cuts.append(j)
    cuts.reverse()
    return total[n - 1], cuts


def split_block(text: str, start: int, end: int, lexicon: Lexicon = NOTHING, last: bool = False) -> list[tuple[int, int]]:
    """The units of ``text[start:end]``, a stretch without blank lines and without white space at its ends; ``last``: nothing follows it."""
    block = _Block(text, start, end, lexicon)
    matches, close, opens = [], [0.0], [0.0]
    final = -1
    for m in _PLACE.finditer(text, start, end):
        final = m.end()
        if final < end and (scores := block.place(m)):
            matches.append(m)
            close.append(scores[0])
            opens.append(scores[1])
    if not matches:
        return [(start, end)]
    bounds = [start, *(m.end() for m in matches), end]
    close.append(0.0)
    opens.append(0.0)
    cut_off = last and final != end
    usual, deviation = lexicon.lengths[script(text[start:end])]
    slope = LENGTH_WEIGHT / deviation
    quotes, unclosed = quotations(text[start:end]) if _QUOTE.search(text, start, end) else ([], [])
    quotes = [(start + a, start + b) for a, b in quotes]
    choices = [quotes] if not unclosed else [quotes + [(start + a, end) for a in unclosed]]
    if unclosed and not cut_off:
        choices.append(quotes)
    best = None
    for k, own in enumerate(choices):
        score, cuts = best_chain(bounds, *_balanced(block, bounds, matches, close, opens, own), usual, slope, cut_off)
        score += STRAY * k * len(unclosed)
        if best is None or score > best[0]:
            best = score, cuts
    out, at = [], start
    for p in [*(bounds[k] for k in best[1]), end]:
        a, b = at, p
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        at = p
    return out


def _balanced(block: _Block, bounds: list[int], matches: list, close: list[float], opens: list[float], quotes: list[tuple[int, int]]) -> tuple:
    """(close, opens, inside, alone): the scores; which places lie inside a quotation; by the place
    after a quotation whose sentence seems to go on, the place before it."""
    if not quotes:
        return close, opens, [False] * len(bounds), {}
    text, start = block.text, block.start
    close, alone = list(close), {}
    starts, ends = sorted(a for a, _ in quotes), sorted(b for _, b in quotes)
    inside = [bisect_left(starts, b) > bisect_left(ends, b) for b in bounds]
    inside[0] = inside[-1] = False
    closes_at = {b: a for a, b in quotes}
    place_at = {b: k for k, b in enumerate(bounds)}
    for k, m in enumerate(matches, 1):
        p = m.end()
        closed = next((i for i in range(p - 1, m.start() - 1, -1) if i in closes_at), None)
        if closed is None:
            continue
        before = opened = closes_at[closed]
        while before > start and text[before - 1].isspace() and before not in place_at:
            before -= 1
        if before in place_at:
            if _goes_on(text, p, opened, closed):
                alone[k] = place_at[before]
        elif close[k] == WORD_OR_QUOTE and _word_before(text, opened, start)[-1:] in (":", ",", "，", "："):
            close[k] = WORD  # the quotation ends the sentence that brought it
    return close, opens, inside, alone


def _goes_on(text: str, end: int, i: int, closed: int) -> bool:
    """Whether the sentence of a quotation from ``i`` to ``closed`` seems to go on (he asked): in
    scripts without case always, in others if a small letter follows."""
    inside = text[i : closed + 1]
    if any(_cased(c) for c in inside) and not any("\u0590" < c < "\ufb00" and c.isalpha() and not _cased(c) for c in inside):
        while end < len(text) and text[end].isspace():
            end += 1
        return end < len(text) and text[end].islower()
    return True


def blocks(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between blank lines, without white space at their ends."""
    at = 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        a, b = at, len(text) if m is None else m.start()
        at = b if m is None else m.end()
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            yield a, b


def units(text: str | None, lexicon: Lexicon = NOTHING) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text; together they cover all but white space."""
    if not text:
        return []
    own = list(blocks(text))
    return [u for k, (a, b) in enumerate(own, 1) for u in split_block(text, a, b, lexicon, k == len(own))]


# What the corpus says

_START = re.compile(rf"(?:\A|\n[^\S\n]*\n|[!?؟।])\s*({_OPENER.pattern})")
_PAIR = re.compile(rf"(?<!\S)(\S+)\.\s+(?=({_OPENER.pattern}))")
_LABEL = re.compile(rf"(?<!\S)[(“„«\"]?({_OPENER.pattern})[ \n](?=[A-ZА-Я](\.|[\s,;:)]))")
_SURE = re.compile(rf"[!?{CASELESS_STOPS}]+\s*|(?<=\w\w\w\w)\.\s+(?=[^\W\d_a-z])|\n\s*\n|(?<=[ก-๛])[^\S\r\n]+(?=[ก-๛])")
START, ANYWHERE, PAIR, LABEL, LENGTH = range(5)
COUNTS = "kind int, a string, b string, n long"
#: Occurrences that the habit of a word's letter case counts as; the most that a word's opening is moved; less is not kept; steps of a log length.
HABIT, MOST, LEAST, STEPS = 10.0, 2.0, 0.25, 10
#: A word whose stops end so often is no abbreviation: what goes on in small letters is carelessness.
ORDINARY = 0.9
#: So many words are sent to every task; with more, each text meets its own by a join.
BROADCAST_WORDS = 200_000


def count(texts: list[str | None]) -> Counter:
    """(kind, a, b) of what ``learn`` needs, counted."""
    starts, anywhere, pairs, labels, lengths = Counter(), Counter(), Counter(), Counter(), Counter()
    for text in texts:
        if not text:
            continue
        starts.update(_START.findall(text))
        anywhere.update(_OPENER.findall(text))
        pairs.update(_PAIR.findall(text))
        labels.update(_LABEL.findall(text))
        lengths.update((script(part), len(part)) for part in map(str.strip, _SURE.split(text)) if part)
    found = Counter({(kind, w, ""): n for kind, own in ((START, starts), (ANYWHERE, anywhere)) for w, n in own.items()})
    for (w, v), n in pairs.items():
        found[PAIR, w.lstrip(OPENING_MARKS).lower(), v] += n
    for (w, stop), n in labels.items():
        found[LABEL, w.lower(), "." if stop == "." else ""] += n
    for (kind, size), n in lengths.items():
        found[LENGTH, kind, str(int(math.log(size) * STEPS))] += n
    return found


def _posterior(words: pd.Series, counts: pd.DataFrame) -> pd.Series:
    """Log odds that a stop after each word ends, by EM: an occurrence ends as likely as the word's stops do and what follows opens. Null if they stay near the prior's."""
    out = []
    for word, row in zip(words, counts.itertuples(index=False)):
        odds, strength = prior(word)
        share = 1 / (1 + math.exp(-odds))
        kept, total = share * strength, strength + sum(row)
        for _ in range(30):
            odds = math.log(share / (1 - share))
            share = (kept + sum(n / (1 + math.exp(-odds - x)) for x, n in zip(_OPENING_BINS, row) if n)) / total
            share = min(max(share, 1e-4), 1 - 1e-4)
        odds, before = math.log(share / (1 - share)), prior(word)[0]
        out.append(odds if abs(odds - before) > LEAST and (before != WORD or share < ORDINARY) else None)
    return pd.Series(out, dtype="float64")


_OPENING_BINS = list(range(-6, 3))
WORDS = "kind int, word string, x double"


def learn(docs: DataFrame, text: str) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """((kind, word, x), lengths): the log odds of the words that the corpus moves, over all texts.

    ``kind`` is START (opens), PAIR (closes) or LABEL. Counting is combined in each task before
    anything is shuffled; of every word only nine numbers meet. The lengths have a few rows.
    """

    def run(batches):
        for batch in batches:
            found = count(batch.column(0).to_pylist())
            kinds, a, b = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(found.values()), pa.int64())], ["kind", "a", "b", "n"]
            )

    counts = spread(docs.select(text).where(F.col(text).isNotNull())).mapInArrow(run, COUNTS)
    counts = stage(counts.groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "counts")

    def of(kind: int) -> DataFrame:
        return counts.where(F.col("kind") == kind)

    def case(c: str) -> Column:
        first = F.substring(c, 1, 1)
        return F.when(F.lower(first) != first, "upper").when(F.upper(first) != first, "lower").otherwise("other")

    words = counts.where(F.col("kind").isin(START, ANYWHERE, PAIR)).groupBy(F.when(F.col("kind") == PAIR, F.col("b")).otherwise(F.col("a")).alias("a"))
    words = words.agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(x) for k, x in ((START, "s"), (ANYWHERE, "w"), (PAIR, "p"))])
    words = words.withColumns({"case": case("a"), "m": F.greatest(F.lit(0), F.col("w") - F.col("s") - F.col("p"))})
    habits = words.groupBy("case").agg(((F.sum("s") + 1) / (F.sum("m") + 1)).alias("r"))  # three rows
    moved = F.log((F.col("s") + HABIT * F.col("r")) / (F.col("m") + HABIT) / F.col("r"))
    opens = words.where("s + p > 0").join(F.broadcast(habits), "case").select("a", F.greatest(F.lit(-MOST), F.least(F.lit(MOST), moved)).alias("x"))
    base = F.when(case("b") == "lower", SMALL).otherwise(0.0)  # a capital says nothing by itself: names follow abbreviations
    pairs = of(PAIR).select(F.col("a").alias("word"), F.col("b").alias("a"), "n", base.alias("base"))
    bins = F.round(F.col("base") + F.coalesce("x", F.lit(0.0))).cast("int")
    pairs = pairs.join(opens, "a", "left").select("word", "n", F.greatest(F.lit(_OPENING_BINS[0]), F.least(F.lit(_OPENING_BINS[-1]), bins)).alias("bin"))
    per = pairs.groupBy("word").agg(*[F.sum(F.when(F.col("bin") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(_OPENING_BINS)])
    solve = F.pandas_udf(_posterior, "double")
    closes = per.select("word", solve("word", F.struct(*[c for c in per.columns if c != "word"])).alias("x")).where("x is not null")
    known = F.lower(F.col("a")).isin(sorted(LABELLED))
    labels = of(LABEL).groupBy("a").agg(F.sum(F.when(F.col("b") == "", F.col("n")).otherwise(0)).alias("bare"), F.sum(F.when(F.col("b") == ".", F.col("n")).otherwise(0)).alias("stop"))
    odds = F.log((F.col("bare") + F.when(known, 10.0).otherwise(0.1)) / (F.col("stop") * 0.1 + F.when(known, 0.1).otherwise(1.0))) * 2
    labels = labels.select(F.col("a").alias("word"), F.greatest(F.lit(ABBREVIATION), F.least(F.lit(WORD), odds)).alias("x"), F.when(known, WORD).otherwise(ABBREVIATION).alias("usual"))
    labels = labels.where(F.abs(F.col("x") - F.col("usual")) > LEAST)
    out = None
    for kind, part in ((START, opens.select(F.col("a").alias("word"), "x").where(f"abs(x) > {LEAST}")), (PAIR, closes), (LABEL, labels)):
        part = part.select(F.lit(kind).alias("kind"), "word", F.col("x").cast("double"))
        out = part if out is None else out.unionByName(part)
    lengths = dict(LENGTHS)
    step = F.col("b").cast("double")
    sums = of(LENGTH).groupBy("a").agg((F.sum(step * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"))
    spreads = of(LENGTH).join(F.broadcast(sums.select("a", "mean")), "a").groupBy("a").agg(F.first("mean").alias("mean"), F.sum("n").alias("n"), F.sum(F.abs(step - F.col("mean")) * F.col("n")).alias("d"))
    for r in spreads.collect():  # a row a script
        usual, deviation = LENGTHS[r["a"]]
        k = 100.0  # units that the prior counts as
        lengths[r["a"]] = ((r["mean"] + 0.5) / STEPS * r["n"] + usual * k) / (r["n"] + k), max(0.2, (r["d"] / STEPS + deviation * k) / (r["n"] + k))
    return stage(out, "lexicon"), lengths


def lexicon_of(rows: list, lengths: dict[str, tuple[float, float]]) -> Lexicon:
    parts: dict[int, dict[str, float]] = {START: {}, PAIR: {}, LABEL: {}}
    for kind, word, x in rows:
        parts[kind][word] = x
    return Lexicon(parts[START], parts[PAIR], parts[LABEL], lengths)


class _Asked(dict):
    """A dictionary that only notes what it is asked for."""

    def get(self, key, default=None):
        self[key] = True
        return default


def asked(text: str) -> list[tuple[int, str]]:
    """(kind, word): what the units of ``text`` depend on."""
    notes = Lexicon(_Asked(), _Asked(), _Asked())
    units(text, notes)
    return [(k, w) for k, part in ((START, notes.opens), (PAIR, notes.closes), (LABEL, notes.labels)) for w in part]


def sentences(df: DataFrame, key: str, text: str, *, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(key, start_pos, end_pos): the units of every text, offsets in code points, end exclusive.

    Null, empty and blank texts give no row; repeated rows give their units each; a null key
    stays null. Other columns are not read. The weights of words are learned from all texts of
    ``df`` first. Up to ``broadcast_words`` of them are sent to every task; with more, every
    distinct text meets its own words by a join, with the same result.
    """
    words, lengths = learn(df, text)
    rows = df.select(F.col(key), F.col(text))
    schema = T.StructType([rows.schema[key], T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType())])
    few = bounded_rows(words, broadcast_words)
    if few is not None:
        whole = df.sparkSession.sparkContext.broadcast([tuple(r) for r in few])
    else:
        whole = None
        rows = _with_words(rows, key, text, words)

    def run(batches):
        held = lexicon_of(whole.value, lengths) if whole is not None else None
        for batch in batches:
            at: list[int] = []
            found: list[tuple[int, int]] = []
            texts = batch.column(1).to_pylist()
            own = [None] * len(texts) if held else batch.column(2).to_pylist()
            for i, (t, ws) in enumerate(zip(texts, own)):
                got = units(t, held or lexicon_of([tuple(w.values()) for w in ws or ()], lengths))
                found.extend(got)
                at.extend([i] * len(got))
            starts, ends = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], [key, "start_pos", "end_pos"]
            )

    return spread(rows).mapInArrow(run, schema)


def _with_words(rows: DataFrame, key: str, text: str, words: DataFrame) -> DataFrame:
    """``rows`` with the weights of each text's own words."""
    from pairloom.operators.joins import join_heavy

    keyed = rows.where(F.col(text) != "").select(F.col(key), F.col(text), F.sha2(text, 256).alias("_text"))

    def run(batches):
        for batch in batches:
            notes = [asked(t) for t in batch.column(1).to_pylist()]
            at = pa.array([i for i, ws in enumerate(notes) for _ in ws], pa.int64())
            kinds, names = [k for ws in notes for k, _ in ws], [w for ws in notes for _, w in ws]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(kinds, pa.int32()), pa.array(names, pa.string())], ["_text", "kind", "word"])

    texts = keyed.groupBy("_text").agg(F.first(text).alias("t"))
    wanted = stage(texts.mapInArrow(run, "_text string, kind int, word string"), "asked")
    uses = wanted.groupBy("kind", "word").agg(F.count("*").alias("n"))
    met = join_heavy(wanted, words.join(uses, ["kind", "word"]), ["kind", "word"], wanted.count())
    own = met.groupBy("_text").agg(F.collect_list(F.struct("kind", "word", "x")).alias("_words"))  # a text's own words
    return keyed.join(own, "_text", "left").select(F.col(key), F.col(text), "_words")
