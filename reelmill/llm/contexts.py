"""PII by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find entities; they are the seeds. The words around a seed induce lexical patterns: the
two words before it, and the word on either side. All other identifier-like strings (something with an
at sign, or groups of digits) are instances of the patterns around them. Patterns and instances form a
graph, scored in turns: a pattern's confidence for a kind is the mean confidence of its instances
(smoothed), an instance's is that of its patterns together (one minus the product of their doubts).
Instances with a confident pattern that has enough different seeds, and with the outward form of
the kind, are discovered. Base findings always stay; discovered ones never overlap them.

Each text is read once; its findings and the contexts of its candidates are stored by the text's
digest, so copies count once in the graph. Hot patterns and identifiers are sums that combine in tasks.

Matches are found by one pass of a linear pattern that brackets them with two private-use characters;
such characters in a text are replaced by a third one first, which matches nothing either.

Defined results: a null text is empty and has no findings; equal texts have equal findings; repeated
rows each get theirs; other columns are ignored by ``find`` and kept by ``redact``; an empty table
gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.llm.batches import other_name
from reelmill.session import small_side, store

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive forms and the places where a match may start keep them
#: linear; what they match is that of the plain patterns, leftmost and non-overlapping.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried on it.
SIGNS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BLANK = r"\x20\x09-\x0D"
#: Digits in groups with narrow separators; a group ends before what looks like an address, a card or a date.
_APART = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}(?![0-9])|[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{4}(?![0-9])"
_JOINT = r"(?:[\x20.:/-]|\)\x20?|\x20?\()"
#: Identifier-like strings: something with an at sign; what looks like an address, a card or a date, each on its own; digits in groups.
CANDIDATE = (
    rf"(?<![^{_BLANK}@])[^{_BLANK}@]++@[^{_BLANK}@]++"
    r"|(?<![0-9])(?:[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++(?:[.:][0-9]++)*+|[0-9]{4}(?:[\x20-][0-9]{4}){3}(?:[\x20-]?[0-9]){0,3}(?![0-9])|[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
    rf"|(?=[0-9\x20().:/-]{{7}})[0-9]++(?:{_JOINT}(?!{_APART})[0-9]++)*+)"
)
#: Outward form that a discovered identifier of each kind must have.
FORMS = {
    "email": r"^[^@]+@[^@]*[A-Za-z0-9][^@]*$",
    "ip": r"^[0-9]+([.:][0-9]+){3,7}$",
    "card": r"^(?=(?:[^0-9]*[0-9]){12,19}[^0-9]*$)[0-9]([\x20-]?[0-9])+$",
    "phone": r"^(?=(?:[^0-9]*[0-9]){7,15}[^0-9]*$)[0-9\x20().-]+$",
}
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
#: Characters on either side of an identifier in which its context is looked for.
NEAR = 64
TURNS = 3
CONFIDENCE, SUPPORT, SMOOTHING = 0.8, 3, 0.5


def plain(text: Column) -> Column:
    """The text without the bracketing characters, as long as before."""
    return F.replace(F.replace(text, F.lit(OPEN), F.lit(OTHER)), F.lit(CLOSE), F.lit(OTHER))


def step(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """Add columns through a one-row generator, so that later uses do not compute them again."""
    return df.select(*keep, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def cut(text: str, pattern: str, sign: str | None) -> Column:
    """The text cut before each match; every part but the first is a match, the closing mark and the rest."""
    marked = F.split(F.regexp_replace(text, pattern, f"{OPEN}$0{CLOSE}"), OPEN)
    whole = F.array(F.col(text))
    return F.when(F.col(text).contains(sign), marked).otherwise(whole) if sign else marked


#: Entries of an array that are added up one after the other; longer arrays go by such pieces.
PIECE = 64


def running(values: Column, combine) -> Column:
    """Running totals of an array of numbers by an associative function.

    Appending to an array copies it, so pieces of ``PIECE`` entries are added up on their own, then the
    pieces' totals; what is copied grows with the square of a 64th of the length.
    """
    none = F.array().cast("array<bigint>")

    def totals(array):
        return F.aggregate(array, none, lambda a, n: F.array_append(a, F.when(F.size(a) > 0, combine(F.try_element_at(a, F.lit(-1)), n)).otherwise(n)))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PIECE).cast("int")), lambda i: totals(F.slice(values, i * PIECE + 1, PIECE)))

    # Lists of one entry, so that pieces and their totals are computed once.
    def after(pieces, before):
        return F.flatten(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.transform(p, lambda n: combine(F.get(before, i - 1), n)))))

    def with_totals(pieces):
        return F.flatten(F.transform(F.array(totals(F.transform(pieces, lambda p: F.try_element_at(p, F.lit(-1))))), lambda before: after(pieces, before)))

    long = F.flatten(F.transform(F.array(pieces), with_totals))
    return F.when(F.size(values) <= PIECE, totals(values)).otherwise(long)


def part_sizes(parts: str) -> Column:
    return F.transform(parts, lambda p, i: (F.length(p) - F.when(i > 0, 1).otherwise(0)).cast("long"))


def spans(parts: str, ends: str) -> Column:
    """start, end, value and the two contexts of every match."""

    def one(i):
        part, before = F.get(parts, i), F.substring_index(F.get(parts, i - 1), CLOSE, -1)
        value = F.substring_index(part, CLOSE, 1)
        left = F.lower(F.right(before, F.lit(NEAR)))
        after = F.lower(F.left(F.substring_index(part, CLOSE, -1), F.lit(NEAR)))
        start = F.get(ends, i - 1)
        return F.struct(
            start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
            F.regexp_extract(left, rf"(?<![^{_BLANK}])[^{_BLANK}]++[{_BLANK}]++[^{_BLANK}]++[{_BLANK}]*$", 0).alias("two"),
            F.regexp_extract(left, rf"(?<![^{_BLANK}])[^{_BLANK}]++[{_BLANK}]*$", 0).alias("one"),
            F.regexp_extract(after, rf"^[{_BLANK}]*[^{_BLANK}]+", 0).alias("next"),
        )

    places = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, one)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def worth(i):
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length(number) - 1), worth), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The test that a match of a base pattern must pass."""
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        number = digits(value)
        return F.when(F.length(number).between(16, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the text's digest, base findings of each kind, and candidates that overlap none; stored."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.md5(text.cast("binary")).alias("_key"), plain(text).alias("_text"))
    keep = ["doc_id", "_key"]
    for kind in (*KINDS, "candidate"):
        pattern, sign = (PATTERNS[kind], SIGNS[kind]) if kind in PATTERNS else (CANDIDATE, None)
        rows = step(rows, [*keep, "_text"], _parts=cut("_text", pattern, sign))
        rows = step(rows, [*keep, "_text", "_parts"], _sizes=part_sizes("_parts"))
        rows = step(rows, [*keep, "_text", "_parts"], _ends=running(F.col("_sizes"), lambda a, b: a + b))
        found = spans("_parts", "_ends")
        if kind in PATTERNS:
            found = F.filter(found, lambda s: valid(kind, s["value"]))
        rows = step(rows, [*keep, "_text"], **{kind: found})
        keep.append(kind)
    base = F.flatten(F.array(*(F.transform(k, lambda s: F.struct(s["start"], s["end"])) for k in KINDS)))
    rows = step(rows, keep, _base=base)
    rows = step(rows, [*keep, "_base"], _order=in_order("candidate", "_base"))
    rows = step(rows, [*keep, "_base", "_order"], _left=running(F.transform("_order", lambda x: F.when(x["base"], x["end"]).otherwise(0)), F.greatest), _right=running(F.transform(F.reverse("_order"), lambda x: F.when(x["base"], x["start"]).otherwise(FAR)), F.least))
    few = F.filter("candidate", lambda c: ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    # Of many, those with a base finding that begins before and reaches into them, or begins in them, are left out.
    many = F.transform(
        F.filter(
            F.transform("_order", lambda x, i: F.struct(x["i"].alias("i"), (~x["base"] & (F.coalesce(F.get("_left", i - 1), F.lit(0)) <= x["start"]) & (F.coalesce(F.get("_right", F.size("_order") - i - 2), F.lit(FAR)) >= x["end"])).alias("free"))),
            lambda x: x["free"],
        ),
        lambda x: F.get("candidate", x["i"]),
    )
    free = F.when(F.size("_order") == 0, few).otherwise(many)
    return store(rows.withColumn("candidate", free).drop("_base", "_order", "_left", "_right"), "entities")


#: Pairs of candidates and base findings of a text that are compared one by one; an end beyond all texts.
COMPARED, FAR = 4096, 1 << 62


def in_order(candidates: str, base: str) -> Column:
    """Candidates (with their number) and base findings by place; none if they are few enough to be compared one by one."""
    both = F.concat(
        F.transform(candidates, lambda c, i: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(False).alias("base"), i.alias("i"))),
        F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(True).alias("base"), F.lit(-1).alias("i"))),
    )
    return F.when(F.size(candidates).cast("long") * F.size(base) > COMPARED, F.array_sort(both)).otherwise(F.slice(both, 1, 0))


def occurrences(scanned: DataFrame) -> DataFrame:
    """One row for each entity or candidate of each different text and pattern around it: kind, value, pattern, place."""
    texts = scanned.dropDuplicates(["_key"])
    listed = F.flatten(F.array(*(F.transform(k, lambda s: F.struct(F.lit(k).alias("kind"), s.alias("s"))) for k in (*KINDS, "candidate"))))
    rows = texts.select("_key", F.explode(listed).alias("x")).select("_key", "x.kind", "x.s.*")
    squeeze = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), rf"[{_BLANK}]+", " "), "[0-9]", "0")
    before = F.when(F.col("two") != "", F.concat(squeeze(F.col("two")), F.lit(" _")))
    around = F.when((F.col("one") != "") & (F.col("next") != ""), F.concat(squeeze(F.col("one")), F.lit(" _ "), squeeze(F.col("next"))))
    rows = rows.withColumn("pattern", F.explode(F.array(before, around))).where("pattern is not null")
    return rows.select("_key", F.when(F.col("kind") != "candidate", F.col("kind")).alias("kind"), F.lower("value").alias("value"), "pattern", "start", "end")


def fits(kind: Column, value: Column) -> Column:
    """Whether a value has the outward form of a kind."""
    test = F.lit(False)
    for k, form in FORMS.items():
        test = F.when(kind == k, value.rlike(form)).otherwise(test)
    return test


def confident_patterns(found: DataFrame, turns: int = TURNS) -> DataFrame:
    """pattern, kind and confidence of the patterns that discover; scored in ``turns`` turns."""
    edges = store(found.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind is not null").select("value", "kind").distinct()
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    support = edges.join(seeds.withColumnRenamed("kind", "k"), "value").groupBy("pattern", F.col("k").alias("kind")).agg(F.count(F.lit(1)).alias("seeds"))
    known = store(sizes.join(support.where(F.col("seeds") >= SUPPORT), "pattern"), "patterns")
    edges = edges.select("pattern", "value").join(known.select("pattern").distinct(), "pattern", "left_semi")
    edges = store(edges, "edges")
    instances = seeds.withColumn("trust", F.lit(1.0))
    scores = None
    for turn in range(turns):
        mass = edges.join(instances, "value").groupBy("pattern", "kind").agg(F.sum("trust").alias("mass"))
        scores = known.join(mass, ["pattern", "kind"]).withColumn("confidence", F.col("mass") / (F.col("n") + SMOOTHING))
        scores = store(scores.select("pattern", "kind", "seeds", "confidence"), "scores")
        if turn + 1 < turns:
            doubt = edges.join(scores, "pattern").groupBy("value", "kind").agg(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.99)))).alias("doubt"))
            reached = doubt.where(fits(F.col("kind"), F.col("value"))).select("value", "kind", (1 - F.exp("doubt")).alias("trust"))
            # Seeds keep their full trust in their own kind and gain none in another.
            reached = reached.join(seeds.select("value"), "value", "left_anti")
            instances = store(seeds.withColumn("trust", F.lit(1.0)).unionByName(reached), "instances")
    return scores.where(F.col("confidence") >= CONFIDENCE)


def discoveries(found: DataFrame, patterns: DataFrame) -> DataFrame:
    """_key and the discovered spans of every text that has any."""
    reached = found.where("kind is null").drop("kind").join(patterns.select("pattern", "kind", "confidence"), "pattern")
    reached = reached.where(fits(F.col("kind"), F.col("value")))
    best = reached.groupBy("_key", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"))
    return best.groupBy("_key").agg(F.collect_list(F.struct(F.col("b.kind").alias("kind"), "start", "end")).alias("more"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text and findings (kind, start, end, base) by kind as listed, then start, of every row.

    The digest is that of the text, by which copies can share their findings.
    """
    scanned = scan(docs)
    found = store(occurrences(scanned), "occurrences")
    # Copies of a text are many rows with one key: the few texts with discoveries are sent to them if measured to be small.
    more = small_side(discoveries(found, confident_patterns(found)))
    rows = scanned.drop("candidate").join(more, "_key", "left")
    order = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
    lists = []
    for kind in KINDS:
        base = F.transform(kind, lambda s: F.struct(order[kind].alias("o"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(True).alias("base")))
        lists.append(base)
    found_more = F.coalesce(F.transform("more", lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(False).alias("base"))), F.array())
    findings = F.array_sort(F.concat(*lists, found_more))
    return rows.select("doc_id", "_key", F.transform(findings, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"))).alias("findings"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every finding replaced by its kind in angle brackets; overlapping ones by that of the first."""
    names = docs.columns
    key, spans_, sizes, reached, chars = (other_name(n, names) for n in ("_key", "_spans", "_sizes", "_reached", "_chars"))
    marked = find(docs.select("doc_id", "text")).where(F.size("findings") > 0).dropDuplicates(["_key"])
    listed = F.array_sort(F.transform("findings", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    marked = marked.select(F.col("_key").alias(key), listed.alias(spans_))
    marked = step(marked, [key, spans_], **{reached: running(F.transform(spans_, lambda s: s["end"]), F.greatest)})
    # Spans that overlap those before them go with the first; ``reached`` is how far all up to one go.
    heads = F.filter(
        F.transform(spans_, lambda s, i: F.struct(i.alias("i"), ((i == 0) | (s["start"] >= F.get(reached, i - 1))).alias("head"))), lambda x: x["head"]
    )
    marked = step(marked, [key, spans_, reached], **{sizes: F.transform(heads, lambda x: x["i"])})

    def joined(i, k):
        last = F.when(k < F.size(sizes) - 1, F.get(sizes, k + 1)).otherwise(F.size(spans_)) - 1
        s = F.get(spans_, i)
        return F.struct(s["start"].alias("start"), F.get(reached, last).alias("end"), s["kind"].alias("kind"))

    marked = small_side(marked.select(key, F.transform(sizes, joined).alias(spans_)))
    rows = docs.withColumn(key, F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).join(marked, key, "left")
    rows = step(rows, [*names, spans_], **{chars: F.when(F.col(spans_).isNotNull(), F.split("text", ""))})
    last = F.size(spans_) - 1

    def piece(s, i):
        begin = F.when(i > 0, F.get(spans_, i - 1)["end"]).otherwise(0)
        before = F.array_join(F.slice(chars, (begin + 1).cast("int"), (s["start"] - begin).cast("int")), "")
        rest = F.when(i == last, F.array_join(F.slice(chars, (s["end"] + 1).cast("int"), F.greatest(F.size(chars) - s["end"], F.lit(0)).cast("int")), "")).otherwise("")
        return F.concat(before, F.lit("<"), F.upper(s["kind"]), F.lit(">"), rest)

    text = F.when(F.col(spans_).isNull(), F.col("text")).otherwise(F.array_join(F.transform(spans_, piece), ""))
    rows = step(rows, [c for c in names if c != "text"], text=text)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*names)
