"""How well a spoken line agrees with a block of dialogue: a ladder of evidence, and bounds that spare its costly steps.

From the top: equal words, the line within the block, the block within the line,
fuzzy agreement; then, for searches over a whole script, a fragment of the block
or all words of content.  :class:`Dialogue` holds blocks with postings of their
words and bags of their characters, and gives for a line all blocks that a rung
can accept: the others are never compared.
"""

from __future__ import annotations

from collections import Counter
from functools import cached_property, reduce

import numpy as np

from sceneline.functions.text import fuzzy, token_set_ratio

#: Words that say nothing about their place in a script.
FUNCTION_WORDS = frozenset(
    "a an and are as at be but by course do for from had has have he her here him his how i if in is it its me my no not of on or our she so that the "
    "their them then there they this to up us was we were what when where which who why with yes you your".split()
)
#: The names of the rungs, the versions of the search and their limits.
EXACT, WITHIN, AROUND, FUZZY = "normalized_exact", "normalized_substring", "script_substring", "rapidfuzz"
FRAGMENT, COVERED, RELAXED = "global_partial_fragment", "global_content_token_coverage", "global_relaxed_distinctive_fragment"
VERSIONS = ("v2", "v3", "v4")
_FUZZY_LEAST, _FRAGMENT_LEAST, _RELAXED_LEAST, _COVERAGE, _RELAXED_COVERAGE = 0.80, 0.86, 0.70, 2 / 3, 0.60
_EPS = 1e-9
_BAG = 64


def within(needle: tuple[str, ...], hay: tuple[str, ...]) -> bool:
    n = len(needle)
    return 0 < n <= len(hay) and any(hay[i : i + n] == needle for i in range(len(hay) - n + 1))


def best_window(a: str, b: str, least: float) -> float:
    """Best Indel ratio of the shorter text with windows of its length of the longer one, or with shorter ones at its ends; 0 if below ``least``.

    Windows slide by a character; how many characters a window shares with the text bounds its ratio, and
    only windows whose bound beats the best so far are compared, a machine word per character.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a or not b:
        return 0.0
    best = _windows(a, b, least - _EPS)
    if len(a) == len(b):
        best = max(best, _windows(b, a, max(best, least - _EPS)))
    return best if best >= least - _EPS else 0.0


def _windows(a: str, b: str, floor: float) -> float:
    m, n = len(a), len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, left, shared, best = (1 << m) - 1, Counter(a), 0, floor

    def step(c: str, by: int) -> int:
        """A character comes into the window (-1) or leaves it (+1): how many more it shares."""
        before = left[c]
        left[c] = before + by
        return (before > 0) if by < 0 else -(before >= 0)

    # Windows as they slide: growing at the beginning, full, shrinking at the end.
    for end in range(1, n + m):
        start, stop = max(0, end - m), min(end, n)
        if end <= n and b[end - 1] in where:
            shared += step(b[end - 1], -1)
        if end > m and b[end - m - 1] in where:
            shared += step(b[end - m - 1], 1)
        size = stop - start
        if 2 * shared > best * (m + size):
            row = full
            for c in b[start:stop]:
                u = row & where.get(c, 0)
                row = (row + u | row - u) & full
            best = max(best, 2 * (m - row.bit_count()) / (m + size))
    return best if best > floor else 0.0


def lexical(line: tuple[str, ...], block: tuple[str, ...]) -> tuple[float, str]:
    """Score and rung of a line and a block, without a limit."""
    if not line or not block:
        return 0.0, "none"
    if line == block:
        return 1.0, EXACT
    if within(line, block):
        return 0.99, WITHIN
    if within(block, line):
        return min(0.95, 0.88 + 0.07 * len(block) / len(line)), AROUND
    return fuzzy(line, block), FUZZY


def accepted(line: tuple[str, ...], block: tuple[str, ...], version: str) -> tuple[float, str]:
    """Score and rung by which a search over a whole script takes a block, or (0, "none").

    A line needs a word of content; under v2 three words.  v3 adds fragments and covered words of
    content; v4 takes no single or empty block within the line, and adds a relaxed fragment for
    lines with four different words of content.
    """
    content = [t for t in line if t not in FUNCTION_WORDS]
    if not content or not block or version == "v2" and len(line) < 3:
        return 0.0, "none"
    score, rung = lexical(line, block)
    known = set(block)
    taken = rung != FUZZY or score >= _FUZZY_LEAST
    if not taken and version != "v2" and len(line) >= 3:
        covered = sum(t in known for t in content)
        part = best_window(" ".join(line), " ".join(block), _FRAGMENT_LEAST) if covered >= _COVERAGE * len(content) - _EPS else 0.0
        if part:
            score, rung, taken = min(0.98, part), FRAGMENT, True
        elif covered == len(content) and len(set(content)) >= 2:
            score, rung, taken = 0.92, COVERED, True
    if version == "v4" and (not taken or rung == AROUND and (len(block) < 2 or not known - FUNCTION_WORDS - {"s"})):
        taken, content = False, [t for t in content if t != "s"]
        if len(line) >= 4 and len(set(content)) >= 4 and sum(t in known for t in content) >= _RELAXED_COVERAGE * len(content) - _EPS:
            part = best_window(" ".join(line), " ".join(block), _RELAXED_LEAST)
            if part:
                score, rung, taken = min(0.94, max(0.86, part)), RELAXED, True
    return (score, rung) if taken else (0.0, "none")


class Stack:
    """Texts end to end, for the longest common subsequence of a line with each of them.

    A whole number has a bit for each character of about ``PILE``, so a step for each character of the
    line works on all texts of a pile at once; the bit after each text takes up what its sum carries over.
    """

    PILE, MASKS = 1 << 19, 128

    def __init__(self, texts: list[str]):
        self.piles: list[tuple[np.ndarray, np.ndarray, int, dict[str, int]]] = []  # characters, beginnings, bits of characters, bits of one character
        self.chars = np.array([len(t) for t in texts], dtype=np.int64)
        held, n = [], 0
        for i, t in enumerate(texts):
            held.append(t)
            n += len(t) + 1
            if n >= self.PILE or i == len(texts) - 1:
                codes = np.frombuffer(" ".join([*held, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").copy()
                first = np.cumsum([0, *(len(h) + 1 for h in held)])
                codes[first[1:] - 1], first = _END, first[:-1]
                self.piles.append((codes, first, _bits(codes != _END), {}))
                held, n = [], 0

    def unmatched(self, line: str) -> list[np.ndarray]:
        """For each pile 1 at a character that adds nothing to the longest common subsequence of the line with its text up to there, else 0."""
        left = []
        for codes, _, full, masks in self.piles:
            if len(masks) > self.MASKS:
                masks.clear()
            for c in set(line).difference(masks):
                masks[c] = _bits(codes == ord(c))
            row = full
            for mask in map(masks.__getitem__, line):
                if mask:
                    u = row & mask
                    row = (row + u | row - u) & full
            left.append(np.unpackbits(np.frombuffer(row.to_bytes(-(-len(codes) // 8), "little"), dtype=np.uint8), count=len(codes), bitorder="little"))
        return left

    def common(self, line: str) -> np.ndarray:
        """Length of the longest common subsequence of the line with each text."""
        left = [np.add.reduceat(bits, pile[1], dtype=np.int64) for pile, bits in zip(self.piles, self.unmatched(line), strict=True)]
        return self.chars - np.concatenate(left) if left else self.chars


_END = np.uint32(0xFFFFFFFF)


def _bits(at: np.ndarray) -> int:
    return int.from_bytes(np.packbits(at, bitorder="little").tobytes(), "little")


def _set_bound(n: np.ndarray, both: np.ndarray, one: int, two: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What the token-set ratio can be at most of texts that share ``n`` different words of ``both`` characters.

    ``one`` and ``two`` are the lengths of the sorted different words, ``common`` their longest common subsequence.
    """
    base = both + np.maximum(0, n - 1)
    more = np.minimum(common, np.minimum(one, two) - base)
    by_set = 2 * (both + n + more) / np.maximum(1, one + two)
    by_base = np.where(n > 0, 2 * base / np.maximum(1, base + np.minimum(one, two)), 0.0)
    return np.where((n > 0) & (base >= np.minimum(one, two)), 1.0, np.minimum(1.0, np.maximum(by_set, by_base)))


def _bag(text: str) -> np.ndarray:
    return np.bincount([ord(c) % _BAG for c in text], minlength=_BAG).astype(np.int32)


class Dialogue:
    """Blocks by their different texts: ``numbers[i]`` are the blocks of the words ``texts[i]``."""

    def __init__(self, blocks: list[tuple[int, tuple[str, ...]]]):
        self.numbers: list[list[int]] = []
        self.texts: list[tuple[str, ...]] = []
        self.place: dict[tuple[str, ...], int] = {}
        for number, words in sorted(blocks):
            i = self.place.setdefault(words, len(self.texts))
            if i == len(self.texts):
                self.texts.append(words)
                self.numbers.append([])
            self.numbers[i].append(number)
        postings: dict[str, list[int]] = {}
        for i, words in enumerate(self.texts):
            for t in set(words):
                postings.setdefault(t, []).append(i)
        self.postings = {t: np.array(v) for t, v in postings.items()}
        self.lengths = sorted({len(t) for t in self.texts} - {0})
        joined, sets = [" ".join(t) for t in self.texts], [" ".join(sorted(set(t))) for t in self.texts]
        empty = np.zeros((0, _BAG), dtype=np.int32)
        self.bags, self.set_bags = (np.array([_bag(t) for t in v]) if v else empty for v in (joined, sets))
        self.chars, self.set_chars, self.words = np.array([len(t) for t in joined]), np.array([len(t) for t in sets]), np.array([len(t) for t in self.texts])

    def containing(self, line: tuple[str, ...]) -> set[int]:
        """Texts that may hold the line, and those that it holds."""
        posts = [self.postings.get(t) for t in set(line)]
        found = set() if any(p is None for p in posts) or not posts else set(min(posts, key=len).tolist())
        for n in self.lengths:
            for i in range(len(line) - n + 1):
                at = self.place.get(line[i : i + n])
                if at is not None:
                    found.add(at)
        return found

    @cached_property
    def joined(self) -> list[str]:
        return [" ".join(t) for t in self.texts]

    def saying(self, line: tuple[str, ...]) -> list[int]:
        """Texts in which the joined words of the line (two or more) occur, its first and last also as parts of words."""
        if len(line) < 2:
            return []
        said, at = " ".join(line), range(len(self.texts))
        if len(line) > 2:  # the inner words are whole
            posts = [self.postings.get(t) for t in set(line[1:-1])]
            at = [] if any(p is None for p in posts) else reduce(np.intersect1d, sorted(posts, key=len)).tolist()
        return [i for i in at if said in self.joined[i]]

    def shared(self, words: set[str]) -> np.ndarray:
        """How many of the words each text has."""
        out = np.zeros(len(self.texts), dtype=np.int64)
        for t in words:
            if (at := self.postings.get(t)) is not None:
                out[at] += 1
        return out

    def bounds(self, line: tuple[str, ...]) -> np.ndarray:
        """What the fuzzy score of each text can be at most, by the characters it shares with the line."""
        if not line or not self.texts:
            return np.zeros(len(self.texts))
        text, distinct = " ".join(line), " ".join(sorted(set(line)))
        plain = 2 * np.minimum(self.bags, _bag(text)).sum(axis=1) / (self.chars + len(text))
        # Of the token-set ratio: no part of it shares more characters than the sets do, and none is shorter than these.
        shared = np.minimum(self.set_bags, _bag(distinct)).sum(axis=1)
        by_set = 2 * shared / np.maximum(1, shared + np.minimum(self.set_chars, len(distinct)))
        coverage = np.minimum(self.words, len(line)) / np.maximum(1, np.maximum(self.words, len(line)))
        return np.where(self.words > 0, np.maximum(plain, by_set * coverage), 0.0)

    @cached_property
    def stacks(self) -> tuple[Stack, Stack]:
        return Stack(self.joined), Stack([" ".join(sorted(set(t))) for t in self.texts])

    def tight(self, line: tuple[str, ...]) -> np.ndarray:
        """As :meth:`bounds`, but the plain ratio itself, and of the token-set ratio a bound that mostly is a few characters off.

        What both have comes first in both strings of that ratio; of the other words no more can agree than
        of all different words in their order, as leaving words out of a string leaves a part of it.
        """
        if not line or not self.texts:
            return np.zeros(len(self.texts))
        text, own = " ".join(line), set(line)
        distinct = " ".join(sorted(own))
        whole, sets = self.stacks
        plain = 2 * whole.common(text) / (whole.chars + len(text))
        n, both = np.zeros(len(self.texts), dtype=np.int64), np.zeros(len(self.texts), dtype=np.int64)
        for t in own:
            if (at := self.postings.get(t)) is not None:
                n[at] += 1
                both[at] += len(t)
        by_set = _set_bound(n, both, len(distinct), sets.chars, sets.common(distinct))
        coverage = np.minimum(self.words, len(line)) / np.maximum(1, np.maximum(self.words, len(line)))
        return np.where(self.words > 0, np.maximum(plain, by_set * coverage), 0.0)

    def covered(self, line: tuple[str, ...]) -> np.ndarray:
        """Share of the line's words of content (with repeats, without a single s) that each text has."""
        content = Counter(t for t in line if t not in FUNCTION_WORDS and t != "s")
        out = np.zeros(len(self.texts))
        for t, n in content.items():
            if (at := self.postings.get(t)) is not None:
                out[at] += n
        return out / max(1, sum(content.values()))

    def search(self, line: tuple[str, ...], version: str) -> list[tuple[float, str, int]]:
        """(score, rung, text) of all texts that the ladder accepts."""
        if not any(t not in FUNCTION_WORDS for t in line):
            return []
        at = self.containing(line) | set(np.flatnonzero(self.bounds(line) >= _FUZZY_LEAST - _EPS).tolist())
        if version != "v2":
            # A lone s counts as content before v4's last rung: it can only be what is missing.
            content = [t for t in line if t not in FUNCTION_WORDS]
            lone = sum(t == "s" for t in content)
            least = min(_RELAXED_COVERAGE, (_COVERAGE * len(content) - lone) / max(1, len(content) - lone))
            if least <= 0:
                at |= set(range(len(self.texts)))
            at |= set(np.flatnonzero(self.covered(line) >= least - _EPS).tolist())
        found = ((*accepted(line, self.texts[i], version), i) for i in sorted(at))
        return [f for f in found if f[1] != "none"]

    def ranked(self, line: tuple[str, ...], least: float, top: int, cursor: int, penalty: float) -> list[tuple[float, str, int]]:
        """(score, rung, block) of the ``top`` blocks with a score of ``least`` or more, those before the cursor ranked lower by ``penalty``.

        Texts are compared in the order of what they can score, until none can come among the best.
        """
        sure = self.containing(line)
        can = self.bounds(line)
        can[list(sure)] = np.maximum(can[list(sure)], 1.0)
        back = np.array([all(n < cursor for n in own) for own in self.numbers])
        can = can - penalty * back
        best: list[tuple[float, float, int, str]] = []
        for i in np.argsort(-can, kind="stable").tolist():
            if len(best) == top and can[i] < -best[-1][0] - _EPS:
                break
            score, rung = lexical(line, self.texts[i])
            if score >= least:
                best = sorted([*best, *((-(score - penalty * (n < cursor)), -score, n, rung) for n in self.numbers[i])])[:top]
        return [(-score, rung, n) for _, score, n, rung in best]

    def best_fuzzy(self, line: tuple[str, ...], digits: int = 6) -> tuple[float, int] | None:
        """The best rounded fuzzy score of all blocks, and the first block that has it; null without blocks."""
        can, best = self.tight(line), None
        for i in np.argsort(-can, kind="stable").tolist():
            if best is not None and can[i] < -best[0] - 10.0**-digits:
                break
            found = (-round(fuzzy(line, self.texts[i]), digits), self.numbers[i][0])
            best = found if best is None else min(best, found)
        return None if best is None else (-best[0], best[1])


class Spans:
    """The spans of a block that are ``narrow`` to ``wide`` words long, for the one that agrees best with a line.

    Spans of one beginning are prefixes of the widest, so a step for each character of the line gives the
    plain ratio of all of them; the token-set ratio is bounded as in :meth:`Dialogue.tight`.  Only spans
    whose bound reaches the best so far are compared.
    """

    def __init__(self, block: list[str], narrow: int, wide: int):
        self.block = block
        widths = range(narrow, min(wide, len(block)) + 1)
        self.at = [(w, a) for w in widths for a in range(len(block) - w + 1)]
        self.width, self.begin = (np.array([p[k] for p in self.at], dtype=np.int64) for k in (0, 1))
        texts = [" ".join(block[a : a + wide]) for a in range(len(block))]
        sums = np.cumsum([0, *(len(t) for t in block)])
        first = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.chars = sums[self.begin + self.width] - sums[self.begin] + self.width - 1
        self.first, self.last = first[self.begin], first[self.begin] + self.chars
        self.whole, self.sets = Stack(texts), Stack([" ".join(sorted(set(block[a : a + w]))) for w, a in self.at])

    def best(self, line: list[str], start: int) -> tuple[float, int, int] | None:
        """(fuzzy score, first word, width) of the best span from ``start`` on; ties to the narrowest, then to the first."""
        if not np.any(self.begin >= start):
            return None
        text, own = " ".join(line), set(line)
        distinct = " ".join(sorted(own))
        left = np.cumsum(np.concatenate([[0], *self.whole.unmatched(text)]), dtype=np.int64)
        both_chars = self.chars + len(text)
        plain = np.where(both_chars > 0, 2 * (self.chars - (left[self.last] - left[self.first])) / np.maximum(1, both_chars), 1.0)
        n, both = np.zeros(len(self.at), dtype=np.int64), np.zeros(len(self.at), dtype=np.int64)
        for t in own.intersection(self.block):
            seen = np.cumsum([0, *(t == word for word in self.block)])
            here = seen[self.begin + self.width] > seen[self.begin]
            n += here
            both += here * len(t)
        by_set = _set_bound(n, both, len(distinct), self.sets.chars, self.sets.common(distinct))
        can = by_set * np.minimum(self.width, len(line)) / np.maximum(self.width, len(line))
        plain[self.begin < start] = can[self.begin < start] = -1.0
        first = int(np.argmax(plain))
        best = (-float(plain[first]), first)
        for i in np.argsort(-can, kind="stable").tolist():
            if can[i] < 0 or can[i] < -best[0] - _EPS:
                break
            w, a = self.at[i]
            by_set = token_set_ratio(line, self.block[a : a + w]) * min(w, len(line)) / max(w, len(line))
            best = min(best, (-max(float(plain[i]), by_set), i))
        return (-best[0], self.at[best[1]][1], self.at[best[1]][0])
