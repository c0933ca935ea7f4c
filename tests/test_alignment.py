"""Anchors, chains, regions and screenplay parsing on small scripts."""

import itertools
import random

from pyspark.sql import functions as F

from sceneline.functions import text as tx
from sceneline.operators import alignment as al
from sceneline.operators import screenplay as sp
from sceneline.plans import script_queries


def brute_chain(rows):
    best = 0
    for n in range(len(rows), 0, -1):
        for c in itertools.combinations(range(len(rows)), n):
            if all((rows[a][1], rows[a][3]) <= (rows[b][1], rows[b][2]) for a, b in itertools.pairwise(c)):
                return n
    return best


def plain_chain(rows):
    """The quadratic search: first of the longest, earliest predecessor."""
    length, before = [1] * len(rows), [-1] * len(rows)
    for i, r in enumerate(rows):
        for j in range(i):
            if (rows[j][1], rows[j][3]) <= (r[1], r[2]) and length[j] + 1 > length[i]:
                length[i], before[i] = length[j] + 1, j
    at = max(range(len(rows)), key=lambda i: (length[i], -i), default=-1)
    out = []
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def test_chain_has_the_same_rows():
    rng = random.Random(6)
    for n in [*range(12)] * 20 + [400] * 3:
        rows = []
        for i in range(n):
            a = rng.randrange(6)
            rows.append((i, rng.randrange(2 + n // 8), a, a + rng.randrange(1, 4)))
        assert al.longest_chain(rows) == plain_chain(rows)


def test_chain_of_the_query(spark):
    """Every film's chain has the rows of the quadratic search, from words to anchors."""
    lines, blocks = script_queries.script(spark, "/root/testdata/sf0.001")
    place = {}
    text = {}
    for r in blocks.collect():
        text[r["movie_key"], r["block"]] = r["tokens"]
    for r in lines.collect():
        t = r["tokens"]
        if al._informative(t):
            hits = [(b, i) for (m, b), h in text.items() if m == r["movie_key"] for i in range(len(h) - len(t) + 1) if h[i : i + len(t)] == t]
            if len(hits) == 1:
                place.setdefault(r["movie_key"], []).append((r["line"], hits[0][0], hits[0][1], hits[0][1] + len(t)))
    want = set()
    for movie, rows in place.items():
        rows.sort()
        want |= {(movie, *rows[i]) for i in plain_chain(rows)}
    got = al.anchor_chain(al.anchors(lines, blocks)).select("movie_key", "line", "block", "token_start", "token_end").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100


def test_chain_is_longest():
    rng = random.Random(5)
    for _ in range(200):
        rows = []
        for i in range(rng.randrange(9)):
            a = rng.randrange(6)
            rows.append((i, rng.randrange(4), a, a + rng.randrange(1, 4)))
        got = al.longest_chain(rows)
        assert len(got) == brute_chain(rows)
        assert all((rows[a][1], rows[a][3]) <= (rows[b][1], rows[b][2]) for a, b in itertools.pairwise(got))


SCRIPT = [
    "good evening everybody and welcome to the last show of the year",
    "what are you doing here at this hour my old friend",
    "nothing much really",
    "i came to give you back the keys of your red car",
    "keep them you will need them more than i do believe me",
    "thank you",
]


def frames(spark, texts, name):
    rows = [("m", i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"movie_key string, {name} long, text string").withColumn("tokens", tx.tokens(F.col("text"))).drop("text")


def test_align(spark):
    said = [
        "good evening everybody",
        "and welcome to the last show",
        "what are you doing here at this hour, my old friend?",
        "Nothing much, reely",
        "i came to give you back the keys",
        "keep them you will need them more then i do believe me",
        "something else entirely was said in this place",
    ]
    got = {r["line"]: r for r in al.align(frames(spark, said, "line"), frames(spark, SCRIPT, "block")).collect()}
    assert len(got) == len(said)
    assert [got[i]["block_start"] for i in (0, 1, 2, 4, 5)] == [0, 0, 1, 3, 4]
    assert got[2]["method"] == "anchor_normalized_exact"
    assert (got[5]["status"], got[5]["reason"]) == ("needs_review", "low_margin_or_score")  # a split over two blocks scores nearly as well
    assert got[6]["status"] == "no_match"
    empty = al.align(frames(spark, ["what is this all about"], "line"), frames(spark, ["no such words"], "block")).collect()
    assert [(r["status"], r["reason"]) for r in empty] == [("no_match", "insufficient_candidates")]


LINES = [
    ("1 INT. KITCHEN - NIGHT 1", 100, 0),
    ("ANNA walks to the door.", 100, 1),
    ("She stops.", 100, 1),
    ("ANNA (CONT'D)", 300, 2),
    ("(quietly)", 260, 3),
    ("Who is it?", 200, 4),
    ("Tell me now.", 200, 4),
    ("(MORE)", 300, 5),
    ("CUT TO:", 500, 6),
    ("EXT. STREET - 1999", 100, 7),
    ("BOB", 300, 8),
    ("Only me.", 200, 9),
    ("Rain falls.", 100, 10),
]


def test_screenplay(spark):
    rows = [("m", 1, 612.0, t, float(x), 10.0 * i, b) for i, (t, x, b) in enumerate(LINES)]
    lines = spark.createDataFrame(rows, "movie_key string, page int, width double, text string, x0 double, y0 double, source_block int")
    got = [tuple(r) for r in sp.parse(lines).orderBy("scene_order", "source_order").collect()]
    assert [(g[1], g[2], g[5], g[7], g[8], g[9]) for g in got] == [
        (1, "1", "action", "ANNA walks to the door. She stops.", None, None),
        (1, "1", "dialogue", "Who is it? Tell me now.", "ANNA", "quietly"),
        (2, "UNNUMBERED_2", "dialogue", "Only me.", "BOB", None),
        (2, "UNNUMBERED_2", "action", "Rain falls.", None, None),
    ]
    parts = spark.createDataFrame([("12A INT. OLD HOUSE - DAY",), ("EXT. ROAD",)], "t string").select(sp.slug_parts(F.col("t")).alias("s")).select("s.*", sp.scene_id(F.col("s.number")).alias("id"))
    assert [tuple(r) for r in parts.collect()] == [("12A", "INT", "OLD HOUSE", "DAY", "scene_012A"), ("", "EXT", "ROAD", "", "scene_")]
    cues = lines.where(sp.looks_like_cue(F.col("text"), F.col("x0"), F.col("width")))
    assert sorted(r["text"] for r in cues.select("text").collect()) == ["(MORE)", "ANNA (CONT'D)", "BOB"]


def test_similarity():
    assert tx.ratio("abc", "abd") == 2 * 2 / 6
    assert tx.ratio("", "") == 1.0
    assert tx.lcs("abcbdab", "bdcaba") == 4
    assert tx.token_set_ratio(["a", "b"], ["b", "a", "c"]) == 1.0
    assert tx.partial_ratio("abc", "xxabcxx") == 1.0
    assert tx.fuzzy([], ["a"]) == 0.0
    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert tx.lcs(a, b) == table[-1][-1]


def plain_fuzzy(a, b):
    both = lambda x, y: 2 * tx.lcs(x, y) / (len(x) + len(y))  # noqa: E731  (the longest common subsequence is tested above)
    if not a or not b:
        return 0.0
    x, y = set(a), set(b)
    shared, one, two = sorted(x & y), " ".join(sorted(x & y) + sorted(x - y)), " ".join(sorted(x & y) + sorted(y - x))
    of_sets = 1.0 if shared and (x <= y or y <= x) else max([both(one, two)] + [both(" ".join(shared), w) for w in (one, two) if shared])
    return max(both(" ".join(a), " ".join(b)), of_sets * min(len(a), len(b)) / max(len(a), len(b)))


def plain_spans(line, tokens, b, start, high):
    """Best span in block b, and best span over the border to the next, of all spans: (score, first block, last block, from, to, method)."""
    block, n, found = tokens.get(b, []), len(line), []
    inside = [i for i in range(len(block)) if block[i : i + n] == line and n]
    rest = block[start:]
    if inside:
        i = min(inside, key=lambda i: (i < start, i))
        found.append((1.0, b, b, i, i + n, "exact" if n == len(block) else "substring"))
    elif rest and any(line[i : i + len(rest)] == rest for i in range(n)):
        found.append((0.99 * len(rest) / n, b, b, start, len(block), "reverse_substring"))
    else:
        spans = [(i, j) for i in range(start, len(block)) for j in range(i + max(1, n - 3), min(len(block), i + n + 5) + 1)] or ([(start, len(block))] if rest else [])
        scored = [(plain_fuzzy(line, block[i:j]), i, j) for i, j in spans]
        found += [(s, b, b, i, j, "fuzzy") for s, i, j in sorted(scored, key=lambda c: (-c[0], c[2] - c[1], c[1]))[:1]]
    if b < high and rest:
        following = tokens.get(b + 1, [])
        cuts = [(max(start, len(block) - k), min(len(following), n - k)) for k in range(1, n)] if following else []
        scored = [(plain_fuzzy(line, block[i:] + following[:j]), k, i, j) for k, (i, j) in enumerate(cuts)]
        found += [(s - 0.015, b, b + 1, i, j, "fuzzy_two_blocks") for s, _, i, j in sorted(scored, key=lambda c: (-c[0], c[1]))[:1]]
    return found


def plain_align(lines, blocks):
    """A film's lines [(line, tokens)] against its blocks {block: tokens}: line to (status, method, first block, last block, from, to, score, reason)."""
    stand = lambda t, h: [i for i in range(len(h) - len(t) + 1) if h[i : i + len(t)] == t]
    marks = []
    for n, t in lines:
        hits = [(b, i) for b, h in blocks.items() for i in stand(t, h)]
        if al._informative(t) and len(hits) == 1:
            marks.append((n, hits[0][0], hits[0][1], hits[0][1] + len(t)))
    fixed = {marks[i][0]: marks[i] for i in plain_chain(marks)}
    out, cursor, region = {}, None, None
    for at, (n, t) in enumerate(lines):
        if n in fixed:
            _, b, i, j = fixed[n]
            out[n] = ("auto_aligned", "anchor_normalized_exact" if len(t) == len(blocks[b]) else "anchor_unique_substring", b, b, i, j, 1.0, None)
            continue
        left = max((f for f in fixed.values() if f[0] < n), default=None)
        right = min((f for f in fixed.values() if f[0] > n), default=None)
        if left is None and right is None:
            out[n] = ("no_match", None, None, None, None, None, None, "insufficient_candidates")
            continue
        low, high = left[1] if left else max(0, right[1] - 100), min(right[1] if right else left[1] + 100, max(blocks))
        if (left, right) != region:
            region, cursor = (left, right), (low, left[3] if left else 0)
        tokens = {b: h for b, h in blocks.items() if low <= b <= high}
        if right and high == right[1]:
            tokens[high] = tokens[high][: right[2]]

        def only(t, low=low, tokens=tokens, left=left):
            hits = [(b, i) for b, h in tokens.items() for i in stand(t, h) if b > low or i >= (left[3] if left else 0)]
            return hits[0] if len(t) >= 4 and len(hits) == 1 else None

        own = only(t)
        later = [only(u) for m, u in lines[at + 1 :] if m not in fixed and (right is None or m < right[0])]
        last = min([h for h in later if h and h >= cursor], default=(high, 0))[0]
        found = []
        if own and own >= cursor:
            found.append((1.0, own[0], own[0], own[1], own[1] + len(t), "exact" if len(t) == len(tokens[own[0]]) else "substring"))
        else:
            for b in range(cursor[0], min(high, last) + 1):
                skip = min(0.12, 0.004 * (b - cursor[0]))
                found += [(s - skip, *rest) for s, *rest in plain_spans(t, tokens, b, cursor[1] if b == cursor[0] else 0, high)]
        found.sort(key=lambda c: (-c[0], c[1:5]))
        if not found:
            out[n] = ("no_match", None, None, None, None, None, None, "below_review_threshold")
            continue
        score, b0, b1, i, j, method = found[0]
        lead = score - found[1][0] if len(found) > 1 else None
        if method in ("exact", "substring") and len(t) >= 4 or al._informative(t) and score >= 0.82 and (lead is None or lead >= 0.08):
            out[n] = ("auto_aligned", method, b0, b1, i, j, score, None)
            cursor = (b1, j) if j < len(tokens[b1]) else (b1 + 1, 0)
        elif score >= 0.65:
            out[n] = ("needs_review", method, b0, b1, i, j, score, "low_margin_or_score")
        else:
            hits = [(b, i) for b, h in tokens.items() for i in stand(t, h)]
            if len(hits) == 1:
                (b, i), j = hits[0], hits[0][1] + len(t)
                out[n] = ("needs_review", "exact", b, b, i, j, 1.0, "nonmonotonic_exact_fragment")
            else:
                out[n] = ("no_match", None, None, None, None, None, score, "below_review_threshold")
    return out


def test_align_lines_equals_the_plain_version(spark):
    """Every line of every film: status, method, place and score."""
    lines, blocks = script_queries.script(spark, "/root/testdata/sf0.001")
    films, said = {}, {}
    for r in blocks.collect():
        films.setdefault(r["movie_key"], {})[r["block"]] = list(r["tokens"])
    for r in lines.collect():
        said.setdefault(r["movie_key"], []).append((r["line"], list(r["tokens"])))
    want = {(m, n): v for m, own in said.items() for n, v in plain_align(sorted(own), films[m]).items()}
    got = {}
    for r in al.align(lines, blocks).collect():
        got[r["movie_key"], r["line"]] = (r["status"], r["method"], r["block_start"], r["block_end"], r["token_start"], r["token_end"], None if r["score"] is None else round(r["score"], 9), r["reason"])
    want = {k: (*v[:6], None if v[6] is None else round(v[6], 9), v[7]) for k, v in want.items()}
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {} and set(got) == set(want)
    assert {v[0] for v in want.values()} == {"auto_aligned", "needs_review", "no_match"}


def test_spans_have_the_plain_best_and_compare_few(monkeypatch):
    """The first of the best spans, as by trying all; of a long block few spans are compared by their words."""
    from sceneline.functions import evidence

    rng = random.Random(8)
    words = ["a", "the", "of", "keys", "red", "car", "old", "friend", "ab", "ba", "é"]
    for _ in range(400):
        block, line = [rng.choice(words) for _ in range(rng.randrange(15))], [rng.choice(words) for _ in range(rng.randrange(1, 9))]
        narrow, wide, start = max(1, len(line) - 3), len(line) + 5, rng.randrange(4)
        want = None
        for w in range(narrow, wide + 1):
            for a in range(start, len(block) - w + 1):
                s = tx.fuzzy(line, block[a : a + w])
                if want is None or s > want[0]:
                    want = (s, a, w)
        assert evidence.Spans(block, narrow, wide).best(line, start) == want
    seen = []
    monkeypatch.setattr(evidence, "token_set_ratio", lambda a, b: seen.append(b) or tx.token_set_ratio(a, b))
    block = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200)]
    line = [*block[40:45], "zzz"]
    assert evidence.Spans(block, 3, 11).best(line, 0)[1] == 40
    assert len(seen) < 60  # of some 1700


def test_places_of_repeated_words(spark):
    """A line whose rarest word is repeated, in itself and in the block, has every place once."""
    from sceneline.operators import matching as mt

    line = [("m", 1, "x a x".split()), ("m", 2, "x x".split()), ("m", 3, ["q", "x"])]
    block = [("m", 7, "x a x a x x x".split()), ("m", 8, "a x".split())]
    lines, blocks = spark.createDataFrame(line, "movie_key string, line long, tokens array<string>"), spark.createDataFrame(block, "movie_key string, block long, tokens array<string>")
    got = sorted((r["line"], r["block"], r["token_start"]) for r in mt.containment_join(lines, blocks, ["movie_key"], "line", "block").collect())
    assert got == [(1, 7, 0), (1, 7, 2), (2, 7, 4), (2, 7, 5)]


def test_regions_and_places_are_no_grouped_maps_and_no_searches(spark):
    """Lines between anchors stream through their tasks, and a pair of line and block costs one comparison, not one for each place."""
    lines, blocks = frames(spark, ["good evening everybody", "nothing much reely"], "line"), frames(spark, SCRIPT, "block")
    plan = al.align(lines, blocks)._jdf.queryExecution().toString()
    assert "MapInPandas" in plan and "FlatMapCoGroups" not in plan
    assert "lambda" not in al.anchors(lines, blocks)._jdf.queryExecution().toString()
