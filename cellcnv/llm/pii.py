"""Personal data by weak supervision, with DataFrame functions only.

Regular expressions find base spans, which always stay, and looser candidates. Labelers vote on each span: its
strict format, a gazetteer of known parts, words before it, its edges and its digits. Counts by kind and vote
pattern (a small table of fixed size) over all documents feed expectation-maximisation, which estimates how
reliable each labeler is; its posteriors train the final span classifier, a logistic model that is applied as
a column expression. Of candidates that overlap base spans the parts outside stay, unless only a keyword is left;
candidates that score under one half are left out.

Positions are code points, ends exclusive. Defined results: null and empty texts have no spans; repeated rows
are searched each; without any span in the corpus the classifier accepts nothing; extra columns are ignored
by the query form and kept by `redact`; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

SPAN = "array<struct<kind:int,start:int,end:int,votes:int,size:int>>"
LOCAL = "[A-Za-z0-9._%+-]"
#: Entries of an array that are folded or searched together, and characters of a text that are cut together.
BLOCK, CHUNK = 64, 4096

# Patterns of the base kinds and of further candidates. Possessive quantifiers and the tests of
# what stands before only keep the search linear; they change no match.
KINDS = ["email", "ip", "card", "phone", "ssn", "iban", "secret", "name"]
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CANDIDATES = "|".join([
    r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?[\x20]?[=:][\x20]?[\"']?[^\x20\x09-\x0D\"']{6,}+)",
    r"(?<![A-Za-z0-9])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    rf"(?<!{LOCAL}){LOCAL}++[\x20]?(?:\[at\]|\(at\))[\x20]?[A-Za-z0-9-]++(?:(?:\.|[\x20]?(?:\[dot\]|\(dot\))[\x20]?)[A-Za-z0-9-]++)++",
    r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?[\x20][A-Z][a-z]++(?:[\x20][A-Z][a-z]++)?",
])
KEYWORD_ONLY = r"^(?i:password|passwd|pwd|token|secret|api[_-]?key)[\"']?[\x20]?[=:]?[\x20]?[\"']?$"
IP_PARTS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
STRICT = [
    r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$", IP_PARTS, r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4,7}$",
    r"^(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{3,4}$", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$",
    r"(?:[=:][\x20]?[\"']?\S{6,}|^[0-9a-f]{32,})$", r"^(?:Mr|Mrs|Ms|Dr|Prof)\.[\x20][A-Z][a-z]+",
]
GAZETTEER = [
    r"\.(?:com|org|net|edu|gov|io|co|de|fr|es|uk|info|biz)$", r"^(?!0|127\.|255\.)[0-9]", r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", r"^(?:\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-8])|\(?[2-9])", r"^[0-8]",
    r"^(?:AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|CH|CR|CY|CZ|DE|DK|DO|EE|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IS|IT|JO|KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PS|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA|VG|XK)",
    r"(?i:password|token|secret|key)", r"(?:James|John|Mary|Anna|Peter|Paul|Maria|David|Thomas|Smith|Jones|Brown|Miller|Garcia|Martin|Schmidt)",
]
CONTEXT = [
    r"(?i:mail|contact|write to)", r"(?i:\bip\b|server|host|address)", r"(?i:card|visa|credit|payment|account)", r"(?i:phone|tel\b|call|fax|mobile|dial)",
    r"(?i:ssn|social|security)", r"(?i:iban|bank|account|transfer)", r"(?i:password|token|secret|key|login|auth)", r"(?i:dear|name|signed|by)",
]
N_LABELERS = 5


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Every second digit from the right is doubled, with its own digits added; the sum must divide by ten."""
    number = digits(value)

    def at(i):
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(number) - 1), at), F.lit(0), lambda a, b: a + b) % 10 == 0


def accepted(kind: str, value: Column) -> Column:
    """The test that a base match must pass."""
    n = F.length(digits(value))
    if kind == "ip":
        return value.rlike(IP_PARTS)
    if kind == "card":
        return F.when((n >= 16) & (n <= 19), luhn(value)).otherwise(False)
    return (n >= 8) & (n <= 15) if kind == "phone" else F.lit(True)


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, fold, levels: int = 3) -> Column:
    """For each place the fold (of integers from 0 on) of all values before it.

    Long arrays are folded block by block, and the folds of the blocks likewise, so a place costs about BLOCK steps a level.
    """
    folded = lambda a: F.aggregate(a, F.lit(0), fold)
    plain = F.transform(values, lambda _, i: folded(F.slice(values, F.lit(1), i)))
    if levels == 1:
        return plain
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int")), lambda b: folded(F.slice(values, b * BLOCK + 1, BLOCK)))

    def within(before):
        return F.transform(values, lambda _, i: fold(F.get(before, (i / BLOCK).cast("int")), folded(F.slice(values, i - i % BLOCK + 1, i % BLOCK))))

    return F.when(F.size(values) <= BLOCK, plain).otherwise(let(blocks, lambda b: let(running(b, fold, levels - 1), within)))


def added(a: Column, b: Column) -> Column:
    return a + b


def larger(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def located(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Adds `name`: matches of a pattern as (start, value, before, after), in order; before and after reach to the matches beside."""
    m, g = f"{name}_m", f"{name}_g"
    df = df.withColumn(m, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    # Splitting by the same pattern gives the gaps, so lengths of gaps and matches give the positions.
    df = df.withColumn(g, F.when(F.size(m) > 0, F.split(F.col(text), pattern, -1)))
    steps = F.zip_with(m, g, lambda x, y: F.coalesce(F.char_length(x), F.lit(0)) + F.char_length(y))
    beside = lambda i: F.coalesce(F.get(m, i), F.lit(""))

    def match(at):
        return lambda x, i: F.struct(
            (F.get(at, i) + F.char_length(F.get(g, i))).alias("start"), x.alias("value"),
            F.right(F.concat(beside(i - 1), F.get(g, i)), F.lit(24)).alias("before"), F.left(F.concat(F.get(g, i + 1), beside(i + 1)), F.lit(1)).alias("after"),
        )

    found = let(let(steps, lambda s: running(s, added)), lambda at: F.transform(m, match(at)))
    empty = F.array().cast("array<struct<start:int,value:string,before:string,after:string>>")
    return df.withColumn(name, F.when(F.size(m) > 0, found).otherwise(empty)).drop(m, g)


def _kind_of(value: Column) -> Column:
    """Kind number of a candidate, by its form."""
    kind = lambda k: F.lit(KINDS.index(k))
    return (
        F.when(value.rlike(r"[\[(]at[\])]"), kind("email")).when(value.rlike(r"^(?i:password|passwd|pwd|token|secret|api)|^[0-9a-f]{32,}$"), kind("secret"))
        .when(value.rlike(r"^[A-Z]{2}[0-9]{2}"), kind("iban")).when(value.rlike(r"^[0-9]{3}-[0-9]{2}-"), kind("ssn")).when(value.rlike(r"^[A-Z]"), kind("name")).otherwise(kind("phone"))
    )


def _by_kind(kind: Column, patterns: list[str], value: Column) -> Column:
    out = F.lit(False)
    for k, pattern in enumerate(patterns):
        out = F.when(kind == k, value.rlike(pattern)).otherwise(out)
    return out


def _span(kind: Column, found: Column, *more: str) -> Column:
    """A span with its labelers' votes as digits of a number in base three (0 against, 1 abstains, 2 for)."""
    value, start, before = found["value"], found["start"], found["before"]
    end = start + F.char_length(value)
    edge = F.concat(F.right(before, F.lit(1)), F.lit(" "), found["after"])
    number = digits(value)
    two = lambda test: F.when(test, 2).otherwise(0)
    votes = [
        two(_by_kind(kind, STRICT, value)),
        F.when(_by_kind(kind, GAZETTEER, value), 2).otherwise(1),
        F.when(_by_kind(kind, CONTEXT, before), 2).otherwise(1),
        F.when(edge.rlike(r"^[A-Za-z0-9_/-]|[A-Za-z0-9_/-]$"), 0).otherwise(2),
        F.when(number == "", 1).otherwise(two((F.length(number) < 6) | (F.replace(number, F.substring(number, 1, 1), F.lit("")) != ""))),
    ]
    packed = sum((v * 3**i for i, v in enumerate(votes)), F.lit(0))
    size = F.least(F.lit(3), F.floor(F.log2(F.char_length(value).cast("double"))) - 2)
    return F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), packed.cast("int").alias("votes"), F.greatest(F.lit(0), size).cast("int").alias("size"), *(found[c].alias(c) for c in more))


def _base_spans(kind: str) -> Column:
    passed = F.filter(f"pii_{kind}", lambda x: accepted(kind, x["value"]))
    return F.transform(passed, lambda x: _span(F.lit(KINDS.index(kind)), x))


def _count_of(kind: int) -> Column:
    return F.size(F.filter("pii_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def _in_blocks(spans: Column) -> Column:
    """Spans in blocks of neighbours, each with the range that it covers."""

    def block(b):
        part = F.slice(spans, b * BLOCK + 1, BLOCK)
        low, high = F.array_min(F.transform(part, lambda s: s["start"])), F.array_max(F.transform(part, lambda s: s["end"]))
        return F.struct(low.alias("start"), high.alias("end"), part.alias("spans"))

    return F.transform(F.sequence(F.lit(0), ((F.size(spans) - 1) / BLOCK).cast("int")), block)


def _meeting(spans: Column, span: Column) -> Column:
    return F.filter(spans, lambda s: (s["start"] < span["end"]) & (span["start"] < s["end"]))


def _outside(span: Column, over: Column) -> Column:
    """The parts of a candidate that no base span over it (sorted by start) covers, with the candidate's kind and votes."""

    def part(i):
        begin = F.greatest(span["start"], F.coalesce(F.array_max(F.transform(F.slice(over, F.lit(1), i), lambda b: b["end"])), span["start"]))
        end = F.when(i < F.size(over), F.get(over, i)["start"]).otherwise(span["end"])
        return F.struct(span["kind"].alias("kind"), begin.alias("start"), end.alias("end"), span["votes"].alias("votes"), span["size"].alias("size"))

    parts = F.filter(F.transform(F.sequence(F.lit(0), F.size(over)), part), lambda x: x["start"] < x["end"])
    return F.filter(parts, lambda x: ~F.substring(span["value"], x["start"] - span["start"] + 1, x["end"] - x["start"]).rlike(KEYWORD_ONLY))


def annotated(docs: DataFrame, *keep: str) -> DataFrame:
    """Columns `keep`, and arrays pii_base and pii_more of spans with votes."""
    text = "pii_text"
    df = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias(text))
    for kind in KINDS[:4]:
        df = located(df, text, f"pii_{kind}", PATTERNS[kind])
        df = df.withColumn(f"pii_{kind}", _base_spans(kind))
    df = df.withColumn("pii_base", F.concat(*(f"pii_{kind}" for kind in KINDS[:4])).cast(SPAN)).drop(*(f"pii_{kind}" for kind in KINDS[:4]))
    df = located(df, text, "pii_more", CANDIDATES)
    df = df.withColumn("pii_more", F.transform("pii_more", lambda x: _span(_kind_of(x["value"]), x, "value")))
    ordered = F.array_sort("pii_base", lambda x, y: x["start"] - y["start"])
    bare = lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "votes", "size")))

    def trimmed(blocks):
        over = lambda s: F.flatten(F.transform(_meeting(blocks, s), lambda b: _meeting(b["spans"], s)))
        return F.flatten(F.transform("pii_more", lambda s: let(over(s), lambda o: F.when(F.size(o) == 0, F.array(bare(s))).otherwise(_outside(s, o)))))

    some = (F.size("pii_base") > 0) & (F.size("pii_more") > 0)
    more = F.when(some, let(let(ordered, _in_blocks), trimmed)).otherwise(F.transform("pii_more", bare))
    return df.withColumn("pii_more", more.cast(SPAN))


def votes_of(packed: int) -> list[int]:
    return [packed // 3**i % 3 for i in range(N_LABELERS)]


def reliabilities(rows: list[tuple[int, int, int]], rounds: int = 60) -> tuple[list[list[list[float]]], dict[tuple[int, int], float]]:
    """Expectation-maximisation over counts by (kind, votes): how each labeler votes in each class, and the posterior of each row."""
    theta = [[[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]] for _ in range(N_LABELERS)]
    prior = {k: 0.5 for k, _, _ in rows}
    posterior: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for k, packed, _ in rows:
            log = [math.log(1 - prior[k]), math.log(prior[k])]
            for i, v in enumerate(votes_of(packed)):
                for y in (0, 1):
                    log[y] += math.log(theta[i][y][v])
            posterior[k, packed] = 1 / (1 + math.exp(max(-50.0, min(50.0, log[0] - log[1]))))
        # A prior of some imagined votes keeps labelers from swapping sides and probabilities from zero.
        seen = [[[6.0, 3.0, 1.0], [1.0, 3.0, 6.0]] for _ in range(N_LABELERS)]
        by_kind: dict[int, list[float]] = {}
        for k, packed, n in rows:
            p = posterior[k, packed]
            share = by_kind.setdefault(k, [1.0, 2.0])
            share[0] += p * n
            share[1] += n
            for i, v in enumerate(votes_of(packed)):
                seen[i][1][v] += p * n
                seen[i][0][v] += (1 - p) * n
        theta = [[[x / sum(c) for x in c] for c in labeler] for labeler in seen]
        prior = {k: min(0.999, max(0.001, a / b)) for k, (a, b) in by_kind.items()}
    return theta, posterior


def indicators(kind: int, packed: int, size: int) -> list[int]:
    """Numbers of the features that are one: the constant, the kind, each labeler's vote, the size."""
    return [0, 1 + kind, *(1 + len(KINDS) + 3 * i + v for i, v in enumerate(votes_of(packed))), 1 + len(KINDS) + 3 * N_LABELERS + size]


def span_classifier(rows: list[tuple[int, int, int, int]], steps: int = 400, rate: float = 1.0) -> list[float]:
    """Weights of a logistic model trained on (kind, votes, size, count) with the posteriors as soft labels."""
    merged: dict[tuple[int, int], int] = {}
    for k, packed, _, n in rows:
        merged[k, packed] = merged.get((k, packed), 0) + n
    _, posterior = reliabilities([(k, p, n) for (k, p), n in merged.items()])
    weights = [0.0] * (1 + len(KINDS) + 3 * N_LABELERS + 4)
    total = sum(math.log1p(n) for *_, n in rows) or 1.0
    data = [(indicators(k, p, s), posterior[k, p], math.log1p(n) / total) for k, p, s, n in rows]
    for _ in range(steps):
        grad = [1e-3 * w for w in weights]
        for on, target, share in data:
            error = share * (1 / (1 + math.exp(-sum(weights[i] for i in on))) - target)
            for i in on:
                grad[i] += error
        weights = [w - rate * g for w, g in zip(weights, grad)]
    return weights


def train(spans: DataFrame) -> list[float] | None:
    """Weights from the spans of all documents; None if there are none. The counted table has at most 8 x 243 x 4 rows."""
    every = spans.select(F.explode(F.concat("pii_base", "pii_more")).alias("s"))
    counted = every.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.size").alias("size")).count()
    rows = sorted((r["kind"], r["votes"], r["size"], r["count"]) for r in counted.collect())
    return span_classifier(rows) if rows else None


def chosen(weights: list[float] | None) -> Column:
    """Base spans, and the candidates that the classifier accepts, by kind and start."""
    if weights is None:
        return F.col("pii_base")
    w = F.array(*(F.lit(x) for x in weights))

    def score(s):
        out = F.element_at(w, F.lit(1)) + F.element_at(w, s["kind"] + 2)
        for i in range(N_LABELERS):
            out = out + F.element_at(w, F.floor(s["votes"] / F.lit(3**i)).cast("int") % 3 + 2 + len(KINDS) + 3 * i)
        return out + F.element_at(w, s["size"] + 2 + len(KINDS) + 3 * N_LABELERS)

    return F.sort_array(F.concat("pii_base", F.filter("pii_more", lambda s: score(s) >= 0.0)))


def described(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every document."""
    spans = stored(annotated(docs, "doc_id").drop("pii_text"), "spans")
    counts = [_count_of(k) for k in range(4)]
    return spans.select("doc_id", *counts, F.sha2(described(F.sort_array("pii_base")).cast("binary"), 256).alias("base_sha256"), described(chosen(train(spans))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in angle brackets; overlapping spans go as one."""
    columns = docs.columns
    # The row travels as one struct, so no column of the table can clash with those made here.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row_"), "text")
    df = stored(annotated(rows, "row_").drop("pii_text"), "spans")
    weights = train(df)
    found = F.array_sort(F.transform(chosen(weights), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    df = df.select("row_", found.alias("pii_all"), F.coalesce("row_.text", F.lit("")).alias("pii_text"))
    marks = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    size = F.char_length("pii_text")
    chunks = F.transform(F.sequence(F.lit(0), (size / CHUNK).cast("int")), lambda c: F.substring(F.col("pii_text"), c * CHUNK + 1, F.lit(CHUNK)))

    def between(chunks, begin, end):
        """A piece of the text from the chunks that it touches, so that no piece is counted from the text's start."""
        first, last = (begin / CHUNK).cast("int"), (end / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), begin - first * CHUNK + 1, end - begin)

    def masked(chunks, reached):
        def piece(s, i):
            begin = F.get(reached, i)
            return F.when(s["start"] >= begin, F.concat(between(chunks, begin, s["start"]), F.element_at(marks, s["kind"] + 1))).otherwise("")

        last = F.array_max(F.transform("pii_all", lambda s: s["end"]))
        return F.concat(F.array_join(F.transform("pii_all", piece), ""), between(chunks, last, size))

    reached = let(F.transform("pii_all", lambda s: s["end"]), lambda e: running(e, larger))
    text = F.when(F.size("pii_all") > 0, let(chunks, lambda c: let(reached, lambda r: masked(c, r)))).otherwise(F.col("row_.text"))
    return df.select(*(text.alias("text") if c == "text" else F.col(f"row_.`{c}`").alias(c) for c in columns))


def op7_pii(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
