"""Personal data against a plain reading of the patterns."""

import hashlib
import random
import re

from sceneline.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base(text):
    out = []
    for m in EMAIL.finditer(text):
        out.append(("email", m))
    for m in IP.finditer(text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m))
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    for m in PHONE.finditer(text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m))
    return [(k, m.start(), m.end()) for k, m in out]


TEXTS = [
    None,
    "",
    "plain text without any",
    "mail bob.x@mail.example.com, or a@b.c_d@e.f and x@y alone",
    "😀 ü ip 10.0.0.255 not 10.0.0.256 nor 1.2.3 but 1.2.3.4.5.6.7.8 and 0000012.1.1.1",
    "card 4041894974608795 and 4041 8949 7460 8795, 4041-8949-7460-8796 no",
    "tel +1 (988) 555-2485. fax +49.30.1234567-, +12 no, ++1 23 45 67 8",
    "9" * 6000 + " " + "1.2" * 3000,
    "a" * 30000 + "@" + "b.c" * 2000,
    "+1 (555) 123-4567 +1 (555) 123-4567 me@me.org me@me.org",
    "write to joe [at] example [dot] org or call 555-123-4567",
]


def rows(seed=4):
    rng = random.Random(seed)
    out = list(TEXTS)
    for _ in range(200):
        bits = []
        for _ in range(rng.randrange(12)):
            bits.append(rng.choice(["".join(rng.choice("0123456789 .-+()@abé😀_%") for _ in range(rng.randrange(25))), f"x{rng.randrange(99)}@m.example.com", f"{rng.randrange(300)}.{rng.randrange(300)}.1.9", f"+1 (9{rng.randrange(99):02}) 555-{rng.randrange(10000):04}", "word word"]))
        out.append(rng.choice([" ", "", ". "]).join(bits))
    return list(enumerate(out))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, "clash") for r in data], "doc_id long, text string, row int, spans string")
    got = {r["doc_id"]: r for r in pii.detect_table(docs).collect()}
    assert len(got) == len(data)
    for i, text in data:
        want = base(text or "")
        assert got[i]["base_sha256"] == hashlib.sha256(joined(want).encode()).hexdigest(), (text, want, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]
        every = [s for s in got[i]["spans"].split(",") if s]
        assert set(joined([w]) for w in want) <= set(every)
        taken = [tuple(map(int, s.split(":")[1:])) for s in every]
        added = [tuple(map(int, s.split(":")[1:])) for s in every if s not in {joined([w]) for w in want}]
        assert all(a >= d or c >= b for a, b in added for c, d in taken if (a, b) != (c, d))


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é me@me.org and 10.0.0.1!", None, 9), (2, "clean", "x", 5), (3, None, None, None), (1, "é me@me.org and 10.0.0.1!", None, 9)], "doc_id long, text string, source string, n_chars long")
    got = pii.redact(docs)
    assert got.columns == docs.columns
    found = sorted((r["doc_id"], r["text"]) for r in got.collect())
    assert found == [(1, "é [EMAIL] and [IP]!"), (1, "é [EMAIL] and [IP]!"), (2, "clean"), (3, None)]


def test_empty(spark):
    assert pii.detect_table(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def with_check_digit(d):
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_spans_without_base_pattern_are_added(spark):
    rng = random.Random(9)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    card = lambda: with_check_digit("4" + n(14))
    texts = []
    for i in range(300):
        texts += [f"words +1 (9{n(2)}) 555-{n(4)} words", f"words bob{i}@m{n(2)}.example.com words", f"words {card()} words"]
    planted = {}
    for i in range(150):  # half as many as the base patterns find
        c = card()
        for kind, span in (
            ("phone", rng.choice([f"1 (9{n(2)}) 555-{n(4)}", f"9{n(2)}-555-{n(4)}", f"9{n(2)}.555.{n(4)}"])),
            ("email", rng.choice(["joe{} [at] example [dot] org", "ann.{}(at)mail.example.com", "x{}@example [dot] net"]).format(i)),
            ("card", ".".join(c[k : k + 4] for k in range(0, 16, 4))),
        ):
            planted[len(texts)] = f"{kind}:6:{6 + len(span)}"
            texts.append(f"words {span} words")
    first_clean = len(texts)
    for _ in range(150):
        c = card()
        texts += [f"words {c[:-1]}{(int(c[-1]) + 1) % 10} words", f"token ab{n(10)}cd{n(8)}f words", f"words 20{n(2)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)} 1{rng.randrange(10)}:3{rng.randrange(10)} words", f"words {rng.randrange(10**8, 10**9)} words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.detect_table(docs).collect()}
    assert [(texts[i], got[i]) for i in planted if got[i] != planted[i]] == []
    assert [(texts[i], got[i]) for i in range(first_clean, len(texts)) if got[i]] == []


def test_secrets_are_added(spark):
    """Learnt from those that are assigned to a name; found without it as well; long words, slugs, paths and numbers stay."""
    rng = random.Random(5)
    hexes = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(26, 41)))
    mixed = lambda: "".join(rng.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") for _ in range(32))
    texts, want = [], []
    for i in range(200):
        v = rng.choice((hexes, mixed))()
        before = rng.choice(('words token = "', "words api_key: ", 'words SECRET="', "words of the "))
        texts.append(f"{before}{v} words")
        want.append([f"secret:{len(before)}:{len(before) + len(v)}"] if len(re.sub("[^0-9]", "", v)) >= 3 else None)
    first_clean = len(texts)
    texts += ["words Donaudampfschifffahrtsgesellschaft2 words", "words https://example.org/archive/2024/05/an-article-on-words words", "words release-notes-for-version-2024 words", "words internationalization2025 words", "words ab-1234567890123456 words"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detect_table(docs).collect()}
    missed = [texts[i] for i in range(first_clean) if want[i] and got[i]["spans"].split(",") != want[i]]
    assert len(missed) <= 0.02 * first_clean, missed
    assert [(texts[i], got[i]["spans"]) for i in range(first_clean, len(texts)) if got[i]["spans"]] == []
    assert all(r["n_added"] == r["n_secret"] == r["n_spans"] for r in got.values())


def test_redact_clashing_names(spark):
    names = ["doc_id", "text", "row", "_row", "_spans", "key", "cuts", "last", "spans", "from"]
    rows = [(str(i), t, *[f"{n}{i}" for n in names[2:]]) for i, t in enumerate(["me@me.org", None, "", "x 10.0.0.1 me@me.org y", "clean"])] * 2
    got = pii.redact(spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names)))
    assert got.columns == names
    want = [(r[0], {"me@me.org": "[EMAIL]", "x 10.0.0.1 me@me.org y": "x [IP] [EMAIL] y"}.get(r[1], r[1]), *r[2:]) for r in rows]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_same_at_every_size(spark):
    """A text is treated alike in a table of one row, of ten and of a thousand."""
    odd = [
        'words token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" words', "words of 7e061fda04dbebab91ab85687d33eeaaf9ac699e words", "words joe [at] example [dot] org words", "words me@me.org words",
        "words 1 (988) 555-2485 words", "words 4041.8949.7460.8795 words", "words 2024-05-11 13:45 words", "words 123456789 words", "words ab-1234567890123456 words", "",
    ]
    rng = random.Random(2)
    for n, plain in ((1, 0), (10, 0), (10, 990)):
        texts = [" ".join(rng.choice(["lorem", "ipsum", "dolor", "12", "sit"]) for _ in range(30)) for _ in range(plain)]
        for part in ([odd] if n == 10 else [[t] for t in odd[:7:2]]):
            docs = spark.createDataFrame(list(enumerate([*part, *texts])), "doc_id long, text string")
            got = {r["doc_id"]: r["spans"] for r in pii.detect_table(docs).collect()}
            kinds = ["secret", "secret", "email", "email", "phone", "card", None, None, None, None]
            at = lambda t: next((t.index(m), t.index(m) + len(m)) for m in re.findall(r'(?<=words )(?:token = "|of )?(.*?)"? words', t))
            want = {t: "{}:{}:{}".format(k, *at(t)) if k else "" for t, k in zip(odd, kinds, strict=True)}
            assert {t: got[i] for i, t in enumerate(part)} == {t: want[t] for t in part}
            assert not any(got[i] for i in range(len(part), len(got)))
