"""Personal data: exact formats, and further spans chosen by boosted trees among overlapping candidates.

Everything that touches texts is a column expression; only a bounded table of counted feature rows
comes to the driver, where the trees are fitted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.boosting import Boosted, fit_boosted, precision_threshold
from tandem.session import staged

# The base formats. Possessive quantifiers and the look-behind only spare the matcher work on
# long runs; ``\G`` lets a match begin where the last one ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Order of kinds in the results; the last is only found by the method.
KINDS = [*BASE, "secret"]

# High-recall generators. Their spans may overlap each other and the base ones.
GENERATORS = [
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9.])"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{14,19}(?![0-9])"),
    ("phone", r"(?<![0-9])(?:\+?[0-9]{1,3}[\x20.-]?|\+)?\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    ("phone", r"(?<![0-9])\+[0-9]{10,15}(?![0-9])"),
    ("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])(?=[0-9_/+-]*+[A-Za-z])[A-Za-z0-9_/+-]{16,}+"),
]
#: Words before a candidate that speak for one of the kinds.
CONTEXT = [
    r"(?i)(key|token|secret|passw|pwd|auth|credential)", r"(?i)(tel|phone|call|fax|mobile)", r"(?i)(mail|contact|write to)",
    r"(?i)(card|visa|iban|account)", r"(?i)(host|server|addr|from ip)",
]
CONTEXT_CHARS = 24
#: The place in ``CONTEXT``, from 1, that announces a kind.
ANNOUNCED = {"secret": 1, "phone": 2, "email": 3, "card": 4}
#: Directly before a secret: an assignment, or a word that needs none.
ASSIGNMENT, TELLING = "[=:]\\s?[\"']?$", "(?i)(bearer|basic|token|key|secret|password|passwd|pwd)\\s[\"']?$"
# Checks that are not the base formats.
ADDRESS = r"^[A-Za-z][A-Za-z0-9._%+-]*@[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]([.]|$)"
NUMBER = (r"^\+|^(1[\x20.-])?\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$"
          r"|^(1[\x20.-])?[2-9][0-9]{2}[.-][2-9][0-9]{2}[.-][0-9]{4}$")
KEY = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_live_|sk-|xox[abprs]-|AIza|eyJ)"
#: Secrets in form only: words and numbers joined, a name with a short number, a UUID, a path or a digest that is called one.
NAME = (r"^([A-Za-z]+|[0-9]+)([_/+-]+([A-Za-z]+|[0-9]+))*[_/+-]*$|^[A-Za-z]+[0-9]{1,4}$"
        r"|^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
CALLED = r"(?i)(commit|sha-?[0-9]*|md5|hash|checksum|digest|uuid|guid|build|version|isbn|doi|href|src|www|file|path)[^A-Za-z0-9]{0,3}$|[/.@#&?]$"
#: Bound of the training table, the precision that sets the thresholds, and steps of a score's logit when they are counted.
SAMPLE_ROWS, PRECISION, BUCKETS = 20_000, 0.95, 50

_SPAN = "array<struct<start: bigint, stop: bigint, txt: string>>"


def _digits(txt: Column) -> Column:
    return F.regexp_replace(txt, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    value = lambda i: F.substring(back, i, 1).cast("int") * (1 + (i - 1) % 2)
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0),
                        lambda s, v: s + v - F.when(v > 9, 9).otherwise(0))
    return total % 10 == 0


def _small_number(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda txt: F.lit(True),
    "ip": lambda txt: F.forall(F.split(txt, "[.]"), _small_number),
    "card": lambda txt: F.when(F.length(_digits(txt)).between(14, 19), _luhn(_digits(txt))).otherwise(False),
    "phone": lambda txt: F.length(_digits(txt)).between(10, 15),
}


def find_spans(text: Column, pattern: str, valid=lambda txt: F.lit(True)) -> Column:
    """``start, stop, txt`` of the valid matches of a pattern, left to right, in code points, stop exclusive.

    What lies between the matches gives their places: the text is split by the pattern, and lengths add up.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        hit = part["hit"]
        start = acc["at"] + F.length(part["gap"])
        stop = start + F.coalesce(F.length(hit), F.lit(0))
        grown = F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), hit.alias("txt"))))
        return F.struct(stop.alias("at"), F.when(hit.isNotNull() & valid(hit), grown).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def _only_if(condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(_SPAN))


def with_base(docs: DataFrame) -> DataFrame:
    """Adds ``_t``, the base spans ``_email, _ip, _card, _phone`` and ``_base``, all of them by start, then kind."""
    found = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    needs = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9][ -]?[0-9]", "phone": "[+][0-9]"}
    found = found.withColumns({
        f"_{kind}": _only_if(F.col("_t").rlike(needs[kind]), find_spans(F.col("_t"), pattern, VALID[kind]))
        for kind, pattern in BASE.items()})
    def of_kind(k: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["stop"].alias("stop"))

    kinds = [F.transform(f"_{kind}", of_kind(k)) for k, kind in enumerate(BASE)]
    return found.withColumn("_base", F.sort_array(F.concat(*kinds)))


def with_candidates(found: DataFrame) -> DataFrame:
    """Adds ``_candidates``: ``start, stop, gen, kind, covered, exact, glued, named`` and the features ``f0 .. fn`` of every proposal."""
    text = F.col("_t")

    def proposed(g: int, kind: int):
        return lambda s: F.struct(
            s["start"].alias("start"), s["stop"].alias("stop"), s["txt"].alias("txt"), F.lit(g).alias("gen"), F.lit(kind).alias("kind"),
            F.substr(text, F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0)).cast("int") + 1,
                     F.least(s["start"], F.lit(CONTEXT_CHARS)).cast("int")).alias("before"),
            F.substr(text, s["stop"].cast("int") + 1, F.lit(1)).alias("after"))

    proposals = F.concat(*[F.transform(find_spans(text, pattern), proposed(g, KINDS.index(kind)))
                           for g, (kind, pattern) in enumerate(GENERATORS)])
    kind = "array<struct<start: bigint, stop: bigint, txt: string, gen: int, kind: int, before: string, after: string>>"
    listed = F.when(text.rlike("[0-9@]"), proposals).otherwise(F.array().cast(kind))
    found = found.withColumn("_proposals", listed)

    def described(c: Column) -> Column:
        same = lambda b: (b["start"] == c["start"]) & (b["stop"] == c["stop"]) & (b["kind"] == c["kind"])
        met = lambda b: (b["start"] < c["stop"]) & (b["stop"] > c["start"])
        features = [f.cast("double").alias(f"f{i}") for i, f in enumerate(_features(c))]
        return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), c["gen"].alias("gen"), c["kind"].alias("kind"),
                        F.exists("_base", met).alias("covered"), F.exists("_base", same).alias("exact"),
                        _glued(c).alias("glued"), (c["txt"].rlike(NAME) | c["before"].rlike(CALLED)).alias("named"), *features)

    return found.withColumn("_candidates", F.transform("_proposals", described))


def _char_class(c: Column) -> Column:
    return F.when(c.rlike("[0-9]"), 3).when(c.rlike("[A-Za-z]"), 2).when(c.rlike(r"\S"), 1).otherwise(0)


def _features(c: Column) -> list[Column]:
    """Format: generator, length, digits, letters, capitals, other characters, dots, hexadecimal throughout. Context: neighbours, words before,
    an assignment (1) or a telling word (2) directly before. Last, whether it stands free and passes the check of its kind."""
    txt, before = c["txt"], c["before"]
    n, digits = F.length(txt), F.length(_digits(txt))
    letters = F.length(F.regexp_replace(txt, "[^A-Za-z]", ""))
    spoken = F.lit(0)
    for k in range(len(CONTEXT), 0, -1):
        spoken = F.when(before.rlike(CONTEXT[k - 1]), k).otherwise(spoken)
    return [
        c["gen"], n, digits, letters, F.length(F.regexp_replace(txt, "[^A-Z]", "")), n - digits - letters,
        F.length(F.regexp_replace(txt, "[^.]", "")), F.when(txt.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 1).otherwise(0),
        _char_class(F.substr(before, F.length(before), F.lit(1))), _char_class(c["after"]), spoken,
        F.when(before.rlike(ASSIGNMENT), 1).when(before.rlike(TELLING), 2).otherwise(0), F.when(_checked(c), 1).otherwise(0),
    ]


N_FEATURES, SAID, ASSIGNED, CHECKED = 13, 10, 11, 12
LABEL_GIVING = [SAID, ASSIGNED, CHECKED]


def _glued(c: Column) -> Column:
    """Part of a longer word, number, address or path."""
    return c["before"].rlike("[A-Za-z0-9_/@.-]$") | c["after"].rlike("[A-Za-z0-9_/@-]") | (c["kind"] == KINDS.index("email")) & c["after"].rlike("[:(]")


def _checked(c: Column) -> Column:
    txt, kind = c["txt"], c["kind"]
    passed = F.lit(False)
    for name, check in {
        "email": txt.rlike(ADDRESS), "ip": VALID["ip"](txt), "card": VALID["card"](txt),
        "phone": F.length(_digits(txt)).between(10, 15) & txt.rlike(NUMBER), "secret": txt.rlike(KEY),
    }.items():
        passed = F.when(kind == KINDS.index(name), check).otherwise(passed)
    return passed & ~_glued(c)


@dataclass
class PiiModel:
    """Trees over the candidate features, and for each generator the score that selects."""

    trees: Boosted
    thresholds: list[float]


def _evidence(c: Column) -> Column:
    """1 for a candidate that is right, 0 for one that is wrong, null where nothing is known.

    A base span is right; candidates that only overlap one are unknown. Of the others, which base formats do not
    cover, those are right that stand free and pass a check of their kind, or that words of their kind announce. All others are wrong; of
    secrets only those that look like names, paths or digests, the rest is unknown.
    """
    said = F.lit(False)
    for kind, word in ANNOUNCED.items():
        said = said | ((c["kind"] == KINDS.index(kind)) & (c[f"f{SAID}"] == word))
    secret = c["kind"] == KINDS.index("secret")
    right = (c[f"f{CHECKED}"] == 1) | said & F.when(secret, c[f"f{ASSIGNED}"] > 0).otherwise(~c["glued"])
    known = F.when(right, 1).when(~secret | c["named"], 0)
    return F.when(c["exact"], 1).when(~c["covered"], known)


def _hidden(names: list[str]) -> list[Column]:
    """The features without those that give the labels."""
    return [(F.lit(0.0) if i in LABEL_GIVING else F.col(f)).alias(f) for i, f in enumerate(names)]


def _shares(counts: dict[tuple, int], rows: int) -> dict[tuple, float]:
    """Of each stratum the share that is taken, so that together about ``rows`` are: small ones whole, the others alike."""
    shares, left = {}, rows
    for k, (stratum, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        taken = min(n, left // (len(counts) - k))
        shares[stratum], left = taken / n, left - taken
    return shares


def train_pii(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, precision: float = PRECISION) -> PiiModel:
    """Trees from weak labels, see ``_evidence``, and thresholds from all documents.

    The distinct feature rows of all documents are counted once and written. About ``sample_rows`` of them, picked by
    hash evenly over generators and labels, fit the trees. Each row takes part twice, once without the features
    that give labels, so that format alone can carry a selection. Then all counted rows, seen both ways again, are summed by generator
    and score: each generator's threshold is the smallest score from which on ``precision`` of its candidates that meet no base
    span are right. Where none of these is right, base spans take part, with the weight of the wrong ones.
    """
    names = [f"f{i}" for i in range(N_FEATURES)]
    found = with_candidates(with_base(docs.select("text")))
    one = found.select(F.explode("_candidates").alias("c"))
    one = one.select(*[F.col(f"c.{f}").alias(f) for f in names], F.col("c.covered").alias("covered"), _evidence(F.col("c")).alias("y"))
    counted = one.where(F.col("y").isNotNull()).groupBy(*names, "covered", "y").agg(F.count(F.lit(1)).alias("n"))
    counted = staged(counted.withColumn("h", F.pmod(F.xxhash64(*names, "y"), F.lit(1 << 30))), "pii-features")
    strata = {(r["f0"], r["y"]): r["n"] for r in counted.groupBy("f0", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares, share = _shares(strata, sample_rows), F.lit(0.0)
    for (g, y), part in shares.items():
        share = F.when((F.col("f0") == g) & (F.col("y") == y), part).otherwise(share)
    picked = counted.where(F.col("h") < share * (1 << 30)).orderBy("h", *names, "covered", "y").limit(sample_rows)
    rows = picked.collect()
    x = np.array([[r[f] for f in names] for r in rows], float).reshape(-1, N_FEATURES)
    y = np.array([r["y"] for r in rows], float)
    w = np.array([r["n"] / shares[(r["f0"], r["y"])] for r in rows], float)
    bare = x.copy()
    bare[:, LABEL_GIVING] = 0
    trees = fit_boosted(np.concatenate([x, bare]), np.concatenate([y, y]), np.concatenate([w, w]))
    both = counted.select(*names, "covered", "y", "n").union(counted.select(*_hidden(names), "covered", "y", "n"))
    margin = trees.margin_column([F.col(f) for f in names])
    bucket = F.floor(F.greatest(F.least(margin, F.lit(30.0)), F.lit(-30.0)) * BUCKETS).alias("b")
    sums = both.select("f0", "covered", bucket, "y", "n").groupBy("f0", "covered", "b").agg(F.sum(F.col("y") * F.col("n")).alias("right"), F.sum("n").alias("n")).collect()
    limits = []
    for g in range(len(GENERATORS)):
        own = [r for r in sums if r["f0"] == g]
        open_ = [r for r in own if not r["covered"]]
        known = any(r["right"] for r in open_)
        own = open_ if known else own
        # base spans stand in for right candidates where there are none, with the weight of the wrong ones
        scale = sum(r["n"] for r in open_) / max(1, sum(r["n"] for r in own if r["covered"])) or 1.0
        # a little below the bucket's edge, so that rounding leaves none of it out
        low = np.array([1 / (1 + np.exp(-(r["b"] - 1e-6) / BUCKETS)) for r in own], float)
        n = np.array([r["n"] for r in own], float)
        right = np.array([r["right"] for r in own], float) / np.maximum(n, 1)
        weight = n * np.array([scale if r["covered"] else 1.0 for r in own], float)
        limits.append(precision_threshold(low, right, weight, precision))
    return PiiModel(trees, limits)


def find_pii(docs: DataFrame, model: PiiModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ``_base`` and ``_spans``: base spans, and with them the selected candidates, as ``start, kind, stop``.

    A selected candidate meets no base span; of selected ones that overlap, the higher score stays, then the
    longer span. Texts are not shuffled. See ``scan_pii`` for defined results.
    """
    found = with_candidates(with_base(docs.select(*dict.fromkeys([*keep, "text"]))))

    def scored(c: Column) -> Column:
        score = model.trees.column([c[f"f{i}"] for i in range(N_FEATURES)])
        limit = F.element_at(F.array(*[F.lit(t) for t in model.thresholds]), c["gen"] + 1)
        return F.struct((-score).alias("rank"), (c["start"] - c["stop"]).alias("size"), c["start"].alias("start"), c["kind"].alias("kind"),
                        c["stop"].alias("stop"), (~c["covered"] & (score >= limit)).alias("chosen"))

    ranked = F.sort_array(F.filter(F.transform("_candidates", scored), lambda c: c["chosen"]))
    empty = F.array().cast("array<struct<start: bigint, kind: int, stop: bigint>>")

    def take(out: Column, c: Column) -> Column:
        free = ~F.exists(out, lambda o: (o["start"] < c["stop"]) & (o["stop"] > c["start"]))
        one = F.array(F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop")))
        return F.when(free, F.concat(out, one)).otherwise(out)

    found = found.withColumn("_ranked", ranked)
    return found.withColumn("_spans", F.sort_array(F.concat("_base", F.aggregate("_ranked", empty, take))))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))))


def scan_pii(docs: DataFrame, model: PiiModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every document.

    The counts and the digest are of the base spans; ``spans`` lists all, base ones always among them.

    Defined results: a null or empty text has no spans; base spans of different kinds may overlap, of one kind they
    do not; repeated rows give repeated results; an empty table gives no rows and a model that selects nothing;
    columns of the input named like results are not read.
    """
    found = find_pii(docs, model, keep)
    counts = [F.size(f"_{kind}").cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select(*keep, *counts, F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_spans").alias("spans"))


def redact(docs: DataFrame, model: PiiModel) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    columns = docs.columns
    found = find_pii(docs.select(F.struct(*[F.col(c) for c in columns]).alias("_doc"), "text"), model, ("_doc",))
    text, names = F.col("_t"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        grown = F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], gap, F.element_at(names, s["kind"] + 1)))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), grown.alias("out"))

    last = lambda acc: F.concat(acc["out"], F.substr(text, acc["at"].cast("int") + 1, F.length(text)))
    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, last)).otherwise(F.col("_doc")["text"])
    redacted = found.withColumn("_clean", clean)
    shown = {"text": F.col("_clean").alias("text"), "n_chars": F.length("_clean").cast("long").alias("n_chars")}
    return redacted.select(*[shown.get(c, F.col("_doc")[c].alias(c)) for c in columns])
