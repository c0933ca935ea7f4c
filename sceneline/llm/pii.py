"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Patterns of high recall propose spans that may overlap: the four base kinds
(email, ip, card, phone, each with its check) and three loose generators
(disguised addresses, runs of digits with separators, and long runs of letters
and digits, which may be secrets: keys, tokens, passwords).  Boosted trees
score the loose candidates from their format and context.  What can be added
meets no base span, so that is no evidence against a candidate: positives are
the candidates that meet a valid base span of their kind, without the sign by
which the base pattern knows them (``+``, ``@``) and in other spellings, and
for secrets the ones that are assigned to a name that says so (which is no
feature); negatives are candidates that fail the check of their kind or are
part of a word, and spellings of the positives that are no personal data.  All
other candidates are unlabelled and teach nothing.  Made examples of every kind
(``seeds``) are always among the labelled ones, so that trees and thresholds
know all kinds whatever the size of the table: a text is treated alike in a
table of one row and in a large one.  Trees learn from a bounded sample;
thresholds are calibrated by kind on matches held out from them.  Base spans
stay; of the others the valid ones above the threshold and free of overlap are
added.

Matches are found where the text is read, and only their lengths and short
contexts go on, so no text is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sceneline.llm.common import checked_broadcast, materialize

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans: the base kinds, and those that only the method finds.
SPAN_KINDS = (*KINDS, "secret")
#: The base patterns, written so that no match attempt is repeated within a run of characters.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "mail": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[{]at[)\]}]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{]dot[)\]}]\x20?)[A-Za-z0-9-]++)++",
    "digits": r"(?<![0-9])[0-9](?:[\x20().:/-]{0,2}+[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_-]{0,24}[0-9])(?=[0-9+/_-]{0,24}[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![.@]?[A-Za-z0-9])",
}
#: What stands before a secret that is given as one.
_ASSIGNED = r"(?:token|secret|passw(?:or)?d|pwd|credentials?|(?:api|access|private|secret|auth)[ _-]?key)[\"'\u201d]?\s{0,2}(?:[:=]|=>|is)\s{0,2}[\"'\u201c]?$"
#: Candidates that the trees are fitted on, at most (one for each hash bucket), and rounds of boosting.
SAMPLE, ROUNDS, DEPTH = 20_000, 12, 3
#: Share of the held-out candidates above a threshold that must be valid.
PRECISION = 0.98
#: Made examples of each kind, each with all its spellings; a fifth of them is for the thresholds.
SEEDS = 100
_CONTEXT = 32
#: Texts with spans, and spans, up to which they are broadcast for redaction (about 50 MB).
BROADCAST_CUTS = 400_000

_PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _count(c: Column, chars: str) -> Column:
    return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("double")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn test."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)
    return (F.length(digits) > 0) & (total % 10 == 0)


def valid(kind: Column, match: Column) -> Column:
    """Whether a match of a base pattern passes the check of its kind."""
    digits = _digits(match)
    n = F.length(digits)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(match, r"\."), lambda p: p.rlike(_PART)))
        .when(kind == "card", F.when((n >= 16) & (n <= 19), luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "secret", (n >= 3) & (F.length(F.regexp_replace(match, "[^A-Za-z]", "")) >= 3) & (F.length(match) >= 16))
        .otherwise((n >= 8) & (n <= 15))
    )


def _found(text: Column, pattern: str) -> Column:
    """Matches with the length of the gap before each and the ends of the gaps around it."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(
        matches,
        F.arrays_zip(
            F.slice(F.transform(gaps, lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(_CONTEXT)).alias("pre"))), F.lit(1), F.size(gaps) - 1).alias("g"),
            F.slice(F.transform(gaps, lambda g: F.left(g, F.lit(8))), F.lit(2), F.size(gaps) - 1).alias("post"),
        ),
        lambda m, z: F.struct(m.alias("match"), z["g"]["gap"].alias("gap"), z["g"]["pre"].alias("pre"), z["post"].alias("post")),
    )


def matches(docs: DataFrame) -> DataFrame:
    """row, doc_id and found: array of (source, array of matches) of every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    has = {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": text.rlike(r"\+[0-9]"),
        "mail": text.rlike(r"@|[(\[{]at[)\]}]"),
        "digits": text.rlike(r"[0-9][\x20().:/-]{0,2}[0-9]"),
        "secret": text.rlike(LOOSE["secret"]),
    }
    every = [F.struct(F.lit(name).alias("source"), F.when(has[name], _found(text, p)).alias("m")) for name, p in {**BASE, **LOOSE}.items()]
    some = text.rlike("[0-9@]|[(\\[{]at[)\\]}]")
    return docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.when(some, F.array(*every)).alias("found"))


def spans(found: DataFrame) -> DataFrame:
    """A row for each match: row, source, match, pre, post, start, end (code points, end exclusive)."""
    rows = found.select("row", F.explode("found").alias("f")).select("row", "f.source", F.posexplode("f.m").alias("i", "m"))
    rows = rows.select("row", "source", "i", "m.*").withColumn("n", F.length("match"))
    w = Window.partitionBy("row", "source").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("n")).drop("gap", "i", "n")


def _flag(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def kind_of(source: Column, match: Column) -> Column:
    """The kind that a loose match can be of."""
    n = F.length(_digits(match))
    octets = F.split(match, r"\.")
    ip = (F.size(octets) == 4) & F.forall(octets, lambda p: p.rlike(r"^[0-9]{1,3}$"))
    return F.when(source == "mail", "email").when(source == "secret", "secret").when(ip, "ip").when((n >= 13) & (n <= 19), "card").otherwise("phone")


def undisguised(match: Column) -> Column:
    """A loose address with @ and dots."""
    match = F.regexp_replace(match, r"\x20?[(\[{]at[)\]}]\x20?", "@")
    return F.regexp_replace(match, r"\x20?[(\[{]dot[)\]}]\x20?", ".")


def shape(kind: Column, match: Column) -> dict[str, Column]:
    """Features of a match; those of an address do not tell how it is disguised."""
    match = F.when(kind == "email", undisguised(match)).otherwise(match)
    n = F.length(_digits(match))
    groups = F.regexp_extract_all(match, F.lit("[A-Za-z0-9]+"), F.lit(0))
    size = F.transform(groups, F.length)
    of_secret = lambda c: F.when(kind == "secret", c).otherwise(F.lit(0)).cast("double")
    runs = F.transform(F.regexp_extract_all(match, F.lit("[A-Za-z]+"), F.lit(0)), F.length)
    return {
        "f_kind": F.array_position(F.array(*map(F.lit, SPAN_KINDS)), kind).cast("double"),
        "f_letters": of_secret(F.aggregate(runs, F.lit(0), lambda a, n: a + n)),
        "f_letter_run": of_secret(F.coalesce(F.array_max(runs), F.lit(0))),
        "f_switches": of_secret(F.regexp_count(match, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"))),
        "f_distinct": of_secret(F.size(F.array_distinct(F.split(match, "")))),
        "f_length": F.length(match).cast("double"),
        "f_digits": n.cast("double"),
        "f_spaces": _count(match, " "),
        "f_dashes": _count(match, "-"),
        "f_dots": _count(match, "."),
        "f_brackets": _count(match, "()[]{}"),
        "f_slashes": _count(match, "/:"),
        "f_groups": F.size(groups).cast("double"),
        "f_first": F.element_at(size, 1).cast("double"),
        "f_last": F.element_at(size, -1).cast("double"),
        "f_longest": F.array_max(size).cast("double"),
        "f_octets": _flag(F.forall(F.split(match, r"\."), lambda p: p.rlike(_PART))),
        "f_luhn": _flag(F.when((n >= 13) & (n <= 19), luhn(_digits(match)))),
        "f_domain": _flag(match.rlike(r"\.[A-Za-z][A-Za-z0-9-]+$")),
    }


def spellings(kind: Column, match: Column) -> Column:
    """A valid base span as it can stand where no base pattern finds it: array of matches."""
    digits = _digits(match)
    rest = F.regexp_replace(match, r"^[0-9]+[\x20().:/-]+", "")  # without the country
    spelt = [F.regexp_replace(c, r"[\x20().:/-]+", sep) for c in (match, rest) for sep in ("-", ".", " ")]
    phone = F.filter(F.array(match, rest, *spelt), lambda v: v.rlike("[^0-9]"))  # a bare run of digits is any number
    card = F.array(match, digits, *[F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", f"$1{sep}") for sep in ("-", ".", " ", "/")])
    secret = F.array(match, F.upper(match), F.lower(match), F.reverse(match))
    every = F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "secret", secret).otherwise(F.array(match))
    return F.filter(F.array_distinct(every), lambda v: valid(kind, v))


def failures(kind: Column, match: Column) -> Column:
    """The characters of a valid base span as something else: a plain number, date, amount, wrong check digit or no domain."""
    digits = _digits(match)
    n = F.length(digits)
    part = lambda a, k: F.substring(digits, a, k)
    date = F.concat_ws("-", part(1, 4), part(5, 2), part(7, 2))
    time = F.concat(date, F.lit(" "), part(2, 2), F.lit(":"), part(4, 2))
    day = F.concat_ws("/", part(1, 2), part(3, 2), part(5, 4))
    amount = F.concat_ws(".", part(1, 3), part(4, 3), part(3, 3))
    phone = F.array(digits, F.substring(digits, 1, 8), date, time, day, F.translate(day, "/", "."), amount, F.concat_ws("-", part(1, 3), part(4, 4)), F.concat_ws("-", digits, digits))
    listed = [F.rtrim(F.regexp_replace(part(1, k), f"([0-9]{{{g}}})", f"$1{sep}")) for k, g in ((8, 2), (10, 2), (9, 3), (12, 3), (8, 1), (12, 4)) for sep in (" ", ". ")]  # lists of numbers
    phone = F.concat(phone, F.array(*[F.rtrim(F.rtrim(c), F.lit(".")) for c in listed], F.repeat(F.concat(part(1, 2), F.lit(" ")), 5)))
    wrong = F.concat(F.left(digits, n - 1), ((F.right(digits, F.lit(1)).cast("int") + 1) % 10).cast("string"))
    card = F.array(wrong, *[F.regexp_replace(wrong, "([0-9]{4})(?=[0-9])", f"$1{sep}") for sep in ("-", ".", " ", "/")])
    ip = F.array(F.regexp_replace(match, "[0-9]+$", "999"))
    mail = F.array(F.regexp_replace(undisguised(match), "[^.]+$", "12"))
    # Of a secret: words with a year, a dated path, a slug, a numbered item, a measure with a long number, serial numbers.
    word = F.lower(F.translate(F.regexp_replace(match, "[^A-Za-z0-9]", ""), "0123456789", "aeioulnrst"))
    w = lambda a, k: F.substring(word, a, k)
    serial = F.lpad(F.abs(F.xxhash64(match)).cast("string"), 20, "3")
    run = lambda a, k: F.substring(serial, a, k)
    year = F.concat(F.lit("20"), F.lpad(F.pmod(F.length(word), F.lit(30)).cast("string"), 2, "0"))
    secret = F.array(
        F.concat(w(1, 14), year), F.concat(F.initcap(w(1, 7)), F.initcap(w(8, 9)), F.lit("2")), F.concat_ws("-", w(1, 6), w(7, 4), w(11, 5), year),
        F.concat_ws("/", w(1, 5), year, F.lit("05"), w(6, 9)), F.concat_ws("_", w(1, 8), w(9, 6), F.lit("1")), F.concat(w(1, 3), F.lit("-"), F.rpad(F.left(digits, F.lit(14)), 14, "0")), F.repeat(F.lit("a1"), 12),
        F.concat(w(1, 2), run(1, 10), w(3, 2), run(11, 8), w(5, 1)), F.concat(w(1, 3), run(1, 14)), F.concat(run(1, 9), w(1, 2), run(11, 9), w(3, 2)), F.concat_ws("-", w(1, 4), run(1, 6), run(7, 8)),
    )
    return F.array_distinct(F.when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "secret", secret).otherwise(mail))


def candidates(rows: DataFrame) -> DataFrame:
    """Loose matches with kind, features of their context and the label: 1, 0 or null (unlabelled)."""
    match, pre, post = F.col("match"), F.lower("pre"), F.col("post")
    context = {
        "f_joined_before": _flag(pre.rlike(r"[\p{L}0-9_=#/.-]$")),
        "f_joined_after": _flag(post.rlike(r"^[\p{L}0-9_=#/@-]")),
        "f_said_phone": _flag(pre.rlike(r"\b(?:tel|phone|call|fax|mobile|cell|contact)\b")),
        "f_said_mail": _flag(pre.rlike(r"\b(?:e-?mail|mail|write|contact)\b")),
        "f_said_card": _flag(pre.rlike(r"\b(?:card|visa|credit|account|iban)\b")),
        "f_said_ip": _flag(pre.rlike(r"\b(?:ip|host|address|server)\b")),
        "f_said_other": _flag(pre.rlike(r"\b(?:version|v|isbn|issn|no|section|page|id|order|date|license)\b[.:]?\s*$")),
    }
    loose = rows.where(F.col("source").isin(*LOOSE)).withColumn("kind", kind_of(F.col("source"), match))
    base = rows.where(F.col("source").isin(*BASE)).where(valid(F.col("source"), match))
    base = base.select("row", F.col("source").alias("kind"), F.struct("start", "end").alias("s"))
    by_row = base.groupBy("row").agg(F.collect_list(F.struct("kind", "s")).alias("_base"))
    loose = loose.join(by_row, "row", "left")
    over = lambda b: (b["s"]["start"] < F.col("end")) & (F.col("start") < b["s"]["end"])
    within = pre.rlike(r"[\p{L}0-9_]$") | post.rlike(r"^[\p{L}0-9_]")
    loose = loose.withColumns(
        {
            "met": F.coalesce(F.exists("_base", lambda b: over(b) & (b["kind"] == F.col("kind"))), F.lit(False)),
            "taken": F.coalesce(F.exists("_base", over), F.lit(False)),
            "valid": valid(F.col("kind"), match) & ~within,
        }
    )
    assigned = (F.col("kind") == "secret") & F.col("valid") & ~F.col("taken") & pre.rlike(_ASSIGNED)
    label = F.when(F.col("met") | assigned, 1.0).when(F.col("taken") | ~F.col("valid"), 0.0)
    return loose.select("row", "kind", "start", "end", "match", label.alias("label"), "taken", "valid", *[c.alias(n) for n, c in context.items()])


def seeds(spark: SparkSession, context: list[str]) -> DataFrame:
    """Made valid spans of every kind: kind, label, match and the features ``context``, by hashes of their numbers."""
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(n))
    number = lambda name, k: F.lpad(draw(name, 10**k).cast("string"), k, "0")
    pick = lambda name, values: F.element_at(F.array(*map(F.lit, values)), draw(name, len(values)).cast("int") + 1)
    word = lambda name, k: F.left(F.translate(F.sha2(F.concat(F.lit(name), F.col("id").cast("string")).cast("binary"), 256), "0123456789", "ghiklmnopr"), F.lit(k))
    sep = pick("sep", [" ", "-", "."])
    hexes = F.sha2(F.concat(F.lit("secret"), F.col("id").cast("string")).cast("binary"), 256)
    mixed = F.translate(F.base64(F.unhex(hexes)), "=", "")
    phone = F.when(draw("form", 2) == 0, F.concat(F.lit("+"), draw("land", 98) + 1, F.lit(" ("), number("area", 3), F.lit(") "), number("a", 3), F.lit("-"), number("b", 4)))
    phone = phone.otherwise(F.concat(F.lit("+"), draw("land", 98) + 1, sep, number("area", 2), sep, number("a", 3), sep, number("b", 4)))
    made = {
        "email": F.concat(word("name", 4), pick("join", [".", "_", "", "-"]), word("last", 6), F.lit("@"), word("host", 7), F.lit("."), pick("top", ["com", "org", "net", "example.com", "co.uk", "de"])),
        "ip": F.concat_ws(".", *[draw(f"octet{i}", 256).cast("string") for i in range(4)]),
        "card": F.concat(pick("issuer", ["4", "51", "37", "60"]), number("card", 13)),
        "phone": phone,
        "secret": F.when(draw("form", 3) == 0, F.left(mixed, (20 + draw("size", 24)).cast("int"))).otherwise(F.left(hexes, (20 + draw("size", 44)).cast("int"))),
    }
    out = spark.range(SEEDS).select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), m.alias("match")) for k, m in made.items()])).alias("m")).select("id", "m.*")
    # Of a card, the one of ten last digits that passes the check.
    ends = F.when(F.col("kind") == "card", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string"))).otherwise(F.array(F.lit("")))
    out = out.withColumn("end", F.explode(ends)).withColumn("match", F.concat("match", "end"))
    out = out.where(F.when(F.col("kind") == "card", luhn(_digits(F.col("match")))).otherwise(valid(F.col("kind"), F.col("match"))))
    said = lambda name: F.when(F.lit(name.startswith("f_said")) & (F.pmod(F.xxhash64(F.lit(name), "kind", "id"), F.lit(4)) == 0), 1.0).otherwise(0.0)
    return out.select("kind", F.lit(1.0).alias("label"), "match", *[said(c).alias(c) for c in context])


def examples(cands: DataFrame) -> DataFrame:
    """Distinct labelled matches and their other spellings, with all features; ``group`` is the same for those of one match."""
    context = [c for c in cands.columns if c.startswith("f_")]
    kind, match = F.col("kind"), F.col("match")
    seen = cands.where("label IS NOT NULL").select("kind", "label", "match", *context).distinct()
    seen = seen.unionByName(seeds(cands.sparkSession, context))
    good = F.transform(spellings(kind, match), lambda v: F.struct(v.alias("v"), F.lit(1.0).alias("label")))
    bad = F.transform(failures(kind, match), lambda v: F.struct(v.alias("v"), F.lit(0.0).alias("label")))
    own = F.array(F.struct(match.alias("v"), F.lit(0.0).alias("label")))
    drawn = seen.withColumn("e", F.explode(F.when(F.col("label") == 1, F.concat(good, bad)).otherwise(own)))
    drawn = drawn.select("kind", F.xxhash64("match").alias("group"), F.col("e.v").alias("match"), F.col("e.label").alias("label"), *context)
    # Only what the generators would give as a candidate of the kind.
    source = F.when(kind == "email", "mail").when(kind == "secret", "secret").otherwise("digits")
    given = F.when(kind == "secret", match.rlike(f"^(?:{LOOSE['secret']})$")).otherwise((kind == "email") | (F.length(_digits(match)) >= 7))
    drawn = drawn.where((kind_of(source, match) == kind) & given)
    return drawn.withColumns(shape(kind, match))


def select(cands: DataFrame) -> DataFrame:
    """row, kind, start, end, p of the loose candidates that trees and thresholds accept."""
    drawn = examples(cands)
    names = [c for c in drawn.columns if c.startswith("f_")]
    # A fifth of the matches, with all their spellings, is for the thresholds.
    for_thresholds = F.pmod("group", F.lit(5)) == 0
    h = F.xxhash64("kind", "label", "match", *names)
    fit = drawn.where(~for_thresholds).withColumn("h", h)
    fit = fit.groupBy(F.pmod("h", F.lit(SAMPLE)).alias("b")).agg(F.min(F.struct("h", "label", *names)).alias("m")).select("m.label", *[f"m.{n}" for n in names])
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    fit = materialize(fit.coalesce(4), "pii-sample")
    train = assemble.transform(fit).select("label", "features")
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=1).fit(train)
    scored = lambda df: model.transform(assemble.transform(df)).withColumn("p", vector_to_array("probability")[1])
    # Calibration: by kind, the lowest of 100 thresholds from which on enough of the held-out examples are valid.
    held = scored(drawn.where(for_thresholds))
    table = held.groupBy("kind", F.floor(F.col("p") * 100).alias("t")).agg(F.sum("label").alias("good"), F.count("*").alias("all")).collect()  # 400 rows
    limits = {}
    for kind in SPAN_KINDS:
        good = total = 0
        for r in sorted((r for r in table if r["kind"] == kind), key=lambda r: -r["t"]):
            good, total = good + r["good"], total + r["all"]
            if good >= PRECISION * total:
                limits[kind] = r["t"] / 100
    passed = reduce(lambda a, b: a | b, [(F.col("kind") == k) & (F.col("p") >= t) for k, t in limits.items()], F.lit(False))
    free = cands.where(F.col("valid") & ~F.col("taken")).withColumns(shape(F.col("kind"), F.col("match")))
    best = scored(free).where(passed).select("row", "kind", "start", "end", "p")
    # Of accepted spans that overlap, the likeliest of each run stays.
    w = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("run", F.sum(F.when(F.col("start") < before, 0).otherwise(1)).over(w))
    order = Window.partitionBy("row", "run").orderBy(F.desc("p"), "start", F.desc("end"), "kind")
    return best.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k", "run")


def detect(docs: DataFrame) -> DataFrame:
    """row, doc_id, base and all: arrays of (kind, start, end) of every row of ``docs``, in the order of the kinds, then of the place."""
    found = materialize(matches(docs), "pii-found")
    rows = materialize(spans(found), "pii-spans")
    cands = materialize(candidates(rows), "pii-candidates")
    place = F.array_position(F.array(*map(F.lit, SPAN_KINDS)), F.col("kind"))
    base = rows.where(F.col("source").isin(*BASE)).where(valid(F.col("source"), F.col("match"))).select("row", F.col("source").alias("kind"), "start", "end", F.lit(True).alias("base"))
    every = base.union(select(cands).select("row", "kind", "start", "end", F.lit(False).alias("base")))
    lists = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind", "base"))).alias("spans"))
    out = found.select("row", "doc_id").join(materialize(lists, "pii-lists"), "row", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(lists.schema["spans"].dataType)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect_table(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind and digest of the base spans, all spans, and counts of those added and of secrets, of every row of ``docs``.

    A null text is empty.  Repeated rows give repeated results, null ids stay null, other
    columns are ignored; an empty table gives an empty result.  Made examples of all kinds are
    always learnt from, so spans are added in a table of any size.
    """
    found = detect(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    added = F.filter("spans", lambda s: ~s["base"])
    secrets = F.filter("spans", lambda s: s["kind"] == "secret")
    more = [F.size(added).cast("long").alias("n_added"), F.size(secrets).cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), *more)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, each span of personal data replaced by its kind in brackets.

    Overlapping spans are replaced as one, by the kind of the first.  A null or empty text stays as
    it is, repeated rows stay repeated, and all columns but ``text`` (and ``n_chars`` if there) keep
    their values, whatever their names; an empty table gives an empty result.

    Spans depend on the text alone, so they are joined by two 64-bit hashes of it: the documents
    are read again, never written.
    """
    key = lambda text: F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(7), text).alias("y"))
    found = detect(docs.select(key(F.col("text")).alias("doc_id"), "text"))
    span = found.where(F.size("spans") > 0).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("key"), F.explode("spans").alias("s"))
    before = Window.partitionBy("key").orderBy("s.start", F.desc("s.end"), "s.place").rowsBetween(Window.unboundedPreceding, -1)
    span = span.withColumn("from", F.coalesce(F.max("s.end").over(before), F.lit(0)))
    cut = F.when(F.col("s.start") >= F.col("from"), F.struct("from", (F.col("s.start") - F.col("from")).alias("n"), F.concat(F.lit("["), F.upper("s.kind"), F.lit("]")).alias("by")))
    hit = materialize(span.groupBy("key").agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.max("s.end").alias("last")), "pii-hit")
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", key(F.col("row.text")))
    rows = rows.join(checked_broadcast(hit, BROADCAST_CUTS, 1 + F.size("cuts")), "key", "left")
    part = lambda a, n: F.substring(F.col("row.text"), a.cast("int") + 1, n.cast("int"))
    parts = F.array_join(F.transform("cuts", lambda c: F.concat(part(c["from"], c["n"]), c["by"])), "")
    done = F.concat(parts, F.substring(F.col("row.text"), F.col("last").cast("int") + 1, F.length("row.text")))
    text = F.when(F.col("cuts").isNull(), F.col("row.text")).otherwise(done)
    rows = rows.withColumn("text", text)
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("cuts").isNull(), F.col("row")["n_chars"]).otherwise(F.length("text").cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*[(fresh[c] if c in fresh else F.col("row")[c]).alias(c) for c in docs.columns])
