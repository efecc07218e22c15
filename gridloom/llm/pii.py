"""Personal data in texts: fixed formats, and boosted trees over the candidates of high-recall generators.

The generators propose overlapping spans. Shape and context of a candidate are a few small numbers, packed into one
key, so the labelled candidates of all texts count up to a table no larger than the grid of keys. The label is that
the candidate overlaps a span of the fixed formats, and what defines these formats (an at sign, a plus, the check
digit, numbers of at most 255) is not among the features: the trees learn where and in which shapes personal data
stands, and find what is written otherwise there, such as a spelled-out at, a telephone number without its plus or
a mistyped card number. For each generator the threshold is the least score down to which every score has PRECISION: on the
fold held back, beside PRIOR candidates of which as many are labelled as the trees say, so few of the fold leave it to
the trees and many decide alone. A key at or above it is selected wherever it occurs. Built-in functions and Spark's
own trees only.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import constant, documents, stored

#: Possessive forms of the four formats: same matches, no recursion in long runs. A run of an address's
#: characters is tried once, at its start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"

#: High recall: addresses with a spelled-out at, three or more dotted numbers, seven or more digits in groups.
AT = r"\x20?(?:@|\(at\)|\[at\])\x20?"
GENERATORS = [
    ("address", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++" + AT + "[A-Za-z0-9.-]++"),
    ("dotted", r"[0-9]++(?:\.[0-9]++){2,}+"),
    ("digits", r"\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+"),
]
#: A country's number with its plus, which the fixed format of telephone numbers asks for: no feature looks at it.
COUNTRY = r"^\+[0-9]{1,3}[ .-]?(?=[0-9(])"
#: Words close before a candidate, by what they announce.
CUES = [r"(?i)mail[^\p{L}]*$", r"(?i)(phone|tel|call|mobile|fax)[^\p{L}]*$", r"(?i)(card|visa|credit|account|iban)[^\p{L}]*$", r"(?i)(\bip|host|server|addr|address)[^\p{L}]*$"]
#: Name and number of values of each feature, lowest digit of the key first.
FEATURES = [("generator", 3), ("shape", 8), ("n_digits", 25), ("n_groups", 9), ("before", 4), ("after", 4), ("cue", 5)]
PRECISION, PRIOR, TREES, DEPTH = 0.9, 20.0, 10, 4
#: Rank of the first generator's spans, after those of the fixed formats.
FIRST_RANK = 4


def luhn(body: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(body, "[^0-9]", "")), "")
    worth = F.transform(
        digits,
        lambda c,
        i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2 - F.when(F.ascii(c) > 52, 9).otherwise(0)),
    )
    return F.aggregate(worth, F.lit(0), lambda a, w: a + w) % 10 == 0


def _n_digits(body: Column) -> Column:
    return F.length(F.regexp_replace(body, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    return spans.ordered(
        F.concat(
            spans.find(text, EMAIL, "email", 0, lambda b: F.lit(True)),
            spans.find(text, IP, "ip", 1, lambda b: F.forall(F.split(b, r"\."), lambda p: p.rlike(OCTET))),
            spans.find(text, CARD, "card", 2, lambda b: _n_digits(b).between(14, 19) & luhn(b)),
            spans.find(text, PHONE, "phone", 3, lambda b: _n_digits(b).between(10, 15)),
        )
    )


def candidates(text: Column) -> Column:
    return F.concat(*[spans.find(text, p, name, FIRST_RANK + i, lambda b: F.lit(True)) for i, (name, p) in enumerate(GENERATORS)])


def _kind(c: Column) -> Column:
    """0 nothing or space, 1 letter, 2 digit, 3 other."""
    return F.when(c.rlike(r"^\s*$"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def _shape(c: Column) -> Column:
    """Of an address: a dot after the at, a last part of letters, digits before the at. Of the others: separators."""
    domain = F.regexp_extract(c["body"], AT + "(.*)$", 1)
    bit = lambda test, n: test.cast("int") * n
    address = bit(F.contains(domain, F.lit(".")), 1) + bit(domain.rlike(r"(^|\.)[A-Za-z]{2,}\.?$"), 2) + bit(c["body"].rlike("^[^@( \\[]*[0-9]"), 4)
    others = bit(c["body"].rlike("[ -]"), 1) + bit(F.contains(c["body"], F.lit(".")), 2) + bit(F.contains(c["body"], F.lit("(")), 4)
    return F.when(c["rank"] == FIRST_RANK, address).otherwise(others)


def _key(text: Column, c: Column) -> Column:
    body, address = F.regexp_replace(c["body"], COUNTRY, ""), c["rank"] == FIRST_RANK
    before = F.substring(text, F.greatest(c["start"] - 15, F.lit(1)), F.least(c["start"], F.lit(16)))
    cue = F.lit(0)
    for k, pattern in enumerate(CUES):
        cue = F.when(before.rlike(pattern), k + 1).otherwise(cue)
    values = [
        c["rank"] - FIRST_RANK,
        _shape(c),
        F.when(address, 0).otherwise(F.least(_n_digits(body), F.lit(24))),
        F.when(address, 0).otherwise(F.least(F.size(F.regexp_extract_all(body, F.lit("[0-9]+"), F.lit(0))), F.lit(8))),
        F.when(c["start"] == 0, 0).otherwise(_kind(F.right(before, F.lit(1)))),
        _kind(F.substring(text, c["end"] + 1, F.lit(1))),
        cue,
    ]
    key, unit = F.lit(0).cast("long"), 1
    for value, (_, n) in zip(values, FEATURES, strict=True):
        key, unit = key + value * F.lit(unit).cast("long"), unit * n
    return key


def _labelled(docs: DataFrame) -> DataFrame:
    """fold, key and label of every candidate of every text; equal texts are in one fold."""
    text, given = F.coalesce("text", F.lit("")), F.col("given")
    found = docs.select(text.alias("given"), candidates(text).alias("c"), (F.pmod(F.xxhash64(text), F.lit(5)) == 0).cast("int").alias("fold"))
    seen = found.where(F.size("c") > 0).withColumn("base", base_spans(given))
    meets = lambda c: F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])).cast("double")
    return seen.select("fold", F.inline(F.transform("c", lambda c: F.struct(_key(given, c).alias("key"), meets(c).alias("label")))))


def _calibrated(scored: list, precision: float, prior: float) -> list[int]:
    """Keys of one generator down to the threshold: the least score before the first that isn't precise enough.

    Scores are taken from the greatest down, each for itself: many sure candidates don't make up for a score that
    stands for as many others as labelled ones.
    """
    levels: dict[float, list[float]] = {}
    for r in scored:
        level = levels.setdefault(r["p"], [prior * r["p"], prior])
        if r["fold"] == 1:
            level[0] += r["n"] * r["label"]
            level[1] += r["n"]
    threshold = None
    for p in sorted(levels, reverse=True):
        if levels[p][0] < precision * levels[p][1]:
            break
        threshold = p
    return [r["key"] for r in scored if threshold is not None and r["p"] >= threshold]


def fit(docs: DataFrame, precision: float = PRECISION, prior: float = PRIOR) -> list[int]:
    """Keys of the candidates to select beside the fixed formats, found from every text.

    At most one row for each key of the grid, label and fold reaches the trees, and the scores of as many the driver.
    Without both labels in the fitted fold there are no trees, and for a generator of which no score is precise enough
    none is selected.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    counted = stored(_labelled(docs).groupBy("fold", "key", "label").agg(F.count("*").cast("double").alias("n")), "candidates").coalesce(1)
    if counted.where("fold = 0").select("label").distinct().count() < 2:
        return []
    unit, names = 1, [name for name, _ in FEATURES]
    for name, n in FEATURES:
        counted, unit = counted.withColumn(name, F.floor(F.col("key") / unit) % n), unit * n
    data = VectorAssembler(inputCols=names, outputCol="features").transform(counted)
    trees = (
        GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, weightCol="n", maxBins=32, cacheNodeIds=False)
        .fit(data.where("fold = 0"))
    )
    scored = (
        trees.transform(data)
        .select("fold", "key", "label", "n", "generator", F.round(vector_to_array("probability")[1], 6).alias("p"))
        .collect()
    )
    chosen = [_calibrated([r for r in scored if r["generator"] == g], precision, prior) for g in range(len(GENERATORS))]
    return sorted({k for keys in chosen for k in keys})


def scan(docs: DataFrame, selected: list[int] | None = None) -> DataFrame:
    """docs with base and spans, arrays of SPAN in order; spans holds base and selected candidates (kind boost).

    Candidates that overlap a base span are left to it. Null text counts as empty. Every row gives one row;
    columns named base or spans are replaced.
    """
    selected = fit(docs) if selected is None else selected
    text, base = F.coalesce("text", F.lit("")), F.col("base")
    out = docs.withColumn("base", base_spans(text))
    if not selected:
        return out.withColumn("spans", base)
    keys = constant(selected, "array<bigint>")
    chosen = F.filter(spans.clear_of(candidates(text), base), lambda c: F.array_contains(keys, _key(text, c)))
    named = F.transform(
        chosen,
        lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"), F.lit("boost").alias("kind"), c["body"].alias("body")),
    )
    return out.withColumn("spans", spans.ordered(F.concat(base, named)))


def cut_out(text: Column, found: Column, mark: Column) -> Column:
    """text with each span of found, which are in order, replaced by mark; overlapping ones as one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.array_append(F.array_append(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"])), mark)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    return F.aggregate(
        found,
        start,
        step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))),
    )


def marked(docs: DataFrame, scan, mark: str) -> DataFrame:
    """docs with every span that scan finds in text replaced by mark; columns of any name stay."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    text = F.when(F.size("spans") > 0, cut_out(F.col("text"), F.col("spans"), F.lit(mark))).otherwise(F.col("text"))
    return scan(held).select(*[text.alias(c) if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns])


def redact(docs: DataFrame, mark: str = "[private]") -> DataFrame:
    """docs with every span of scan() replaced by mark, overlapping spans as one; texts without one, null ones too, stay."""
    return marked(docs, scan, mark)


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every text: fixed formats, and what the trees select; null counts as empty."""
    found = scan(documents(spark, sf_dir))
    counts = [spans.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(spans.written(F.col("base")), 256).alias("base_sha256"),
        spans.written(F.col("spans")).alias("spans"),
    )
