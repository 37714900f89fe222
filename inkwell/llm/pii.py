"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the base spans (fixed patterns with their checks) and looser
ones: spelled-out addresses, national phone numbers, card numbers that fail
their checksum, long-form ips.  Three labelers vote on each (for, against,
silent): its regular expression with the check, a gazetteer (mail domains,
calling codes, card issuers, reserved ip blocks) and the words before it.
The votes of the whole corpus are counted by pattern (kind and three votes:
at most 108 rows, whatever the corpus); expectation-maximisation over these
counts estimates the labelers' reliabilities and the probability of each
pattern; a logistic classifier trained on them decides each loose candidate.
Base spans are always kept.

Edge cases: null text is empty; spans of different kinds may overlap (base
ones are reported as they are, loose ones only where no base span is);
positions are code points; repeated rows are handled one by one; an empty
table fits no model and gives no rows; extra columns are ignored by the query
and kept by ``masked``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import boxed, cut, only, table, unboxed

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context")
_SPAN = "array<struct<kind:int,start:int,end:int,regex:int,gazetteer:int,context:int>>"

# The base patterns.  Possessive quantifiers and the look-behinds keep the
# search linear; they change no match (a run that fails at its start fails at
# every later start; ``\G``: the rest of a run behind the last match).
_LOCAL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": _LOCAL + r"\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# A text without this has no match: a cheap test before the search.
_SIGN = {"email": "@", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]",
         "phone": r"\+[0-9]"}
_LOOSE_SIGN = {"email": r"[\[({]at[\])}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}

# The gazetteers and the words of the context labeler.
DOMAINS = "com|org|net|edu|gov|info|io|co|biz|eu|de|fr|es|it|uk|us|ca|ch|at|nl|be|pl|se|br|mx|ar|in|jp|cn|ru|au"
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[235689][0-9]{2})"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6(?:011|5|4[4-9])|35)"
RESERVED = r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\."
FOR_WORDS = (r"(?:e-?mail|mail|contact|contacto|kontakt|courriel|correo|write to|tel|phone|call|fax|mobile|cell|"
             r"telefon|t[eé]l[eé]fono|appelez|llame|card|visa|mastercard|amex|credit|karte|carte|tarjeta|ip|host|"
             r"server|client|adresse|address)[^\p{L}]{0,12}$")
AGAINST_WORDS = r"(?:version|isbn|issn|order|invoice|sku|serial|section|chapter|part no|ref|total|v)[^\p{L}]{0,12}$"


def _starts(lengths: Column) -> Column:
    """Exclusive running sums of an array of numbers, in blocks of 256 so that
    a text with very many matches stays affordable."""
    def block(off: Column, part: Column) -> Column:
        zero = F.struct(off.alias("off"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, zero, lambda a, x: F.struct(
            (a["off"] + x).alias("off"), F.concat(a["out"], F.array(a["off"])).alias("out")))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / 256).cast("int")),
                        lambda b: F.slice(lengths, b * 256 + 1, 256))
    zero = F.struct(F.lit(0).alias("off"), F.array().cast("array<int>").alias("out"))
    done = F.aggregate(parts, zero, lambda a, p: F.struct(
        block(a["off"], p)["off"].alias("off"), F.concat(a["out"], block(a["off"], p)["out"]).alias("out")))
    return done["out"]


def matches(text: Column, pattern: str, sign: str) -> Column:
    """array<struct<at, m>>: the leftmost non-overlapping matches and their
    places (code points from 0)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found,
                       lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), m.alias("s")))
    at = _starts(F.transform(sizes, lambda x: x["g"] + x["m"]))
    rows = F.zip_with(at, sizes, lambda a, x: F.struct((a + x["g"]).alias("at"), x["s"].alias("m")))
    none = F.array().cast("array<struct<at:int,m:string>>")
    return F.when(text.rlike(sign) & (F.size(found) > 0), rows).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Luhn's checksum over the digits of a match."""
    backwards = F.split(F.reverse(_digits(m)), "")
    parts = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(parts, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
            "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(_digits(m)).between(13, 19) & luhn(m)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _kept(kind: str, rows: Column) -> Column:
    return F.filter(rows, lambda x: _valid(kind, x["m"]))


def _of_kind(spans: str, kind: int) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def _gazetteer(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.when(F.lower(m).rlike(rf"(?:\.|dot[\])}}]\x20?)(?:{DOMAINS})$"), 1).otherwise(0)
    if kind == "phone":
        return F.when(m.rlike(CALLING), 1).otherwise(F.when(m.startswith("+"), -1).otherwise(0))
    if kind == "card":
        return F.when(_digits(m).rlike(ISSUERS), 1).otherwise(-1)
    return F.when(m.rlike(RESERVED), -1).otherwise(1)


def _voted(text: Column, kind: str, rows: Column, regex: Column) -> Column:
    """Adds the three votes to matches of one kind."""
    def one(x: Column) -> Column:
        lead = F.lower(F.substring(text, F.greatest(x["at"] - 39, F.lit(1)), F.least(x["at"], F.lit(40))))
        context = F.when(lead.rlike(AGAINST_WORDS), -1).otherwise(F.when(lead.rlike(FOR_WORDS), 1).otherwise(0))
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["at"].alias("start"),
                        (x["at"] + F.length(x["m"])).alias("end"), regex.alias("regex"),
                        _gazetteer(kind, x["m"]).alias("gazetteer"), context.alias("context"))

    return F.transform(rows, one).cast(_SPAN)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the arrays ``_base`` and ``_loose`` of spans with their votes."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base, loose = [], []
    for kind in KINDS:
        rows = matches(t, BASE[kind], _SIGN[kind])
        base.append(_voted(t, kind, _kept(kind, rows), F.lit(1)))
        if kind == "card":
            fails = F.filter(rows, lambda x: F.length(_digits(x["m"])).between(13, 19) & ~luhn(x["m"]))
            loose.append(_voted(t, kind, fails, F.lit(-1)))
        else:
            loose.append(_voted(t, kind, matches(t, LOOSE[kind], _LOOSE_SIGN[kind]), F.lit(0)))
    d = docs.withColumns({"_base": F.concat(*base), "_all": F.concat(*loose)})
    free = F.filter("_all", lambda x: ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return d.withColumn("_loose", free).drop("_all")


def estimate(patterns: list[tuple[tuple, int]], rounds: int = 30) -> list[float]:
    """Expectation-maximisation: probability that a span of each pattern
    (kind, votes...) is personal data.  ``patterns``: with their counts."""
    post = [1 / (1 + math.exp(-2.0 * sum(p[1:]))) for p, _ in patterns]
    for _ in range(rounds):
        prior: dict = {}
        vote: dict = {}
        for ((kind, *votes), n), q in zip(patterns, post):
            for y, w in ((1, n * q), (0, n * (1 - q))):
                prior[kind, y] = prior.get((kind, y), 1.0) + w
                for i, v in enumerate(votes):
                    vote[i, y, v] = vote.get((i, y, v), 0.0) + w
        total = {(i, y): sum(vote.get((i, y, v), 0.0) + 0.5 for v in (-1, 0, 1)) for i in range(3) for y in (0, 1)}
        post = []
        for (kind, *votes), _ in patterns:
            logs = [math.log(prior[kind, y] / (prior[kind, 0] + prior[kind, 1])) + sum(
                math.log((vote.get((i, y, v), 0.0) + 0.5) / total[i, y]) for i, v in enumerate(votes)) for y in (0, 1)]
            post.append(1 / (1 + math.exp(min(50.0, logs[0] - logs[1]))))
    return post


def _features(kind, votes) -> list:
    return [*[(kind == i) for i in range(len(KINDS))], *[(v == s) for v in votes for s in (1, -1)]]


def fit(found: DataFrame) -> tuple[float, list[float]] | None:
    """(intercept, weights) of the span classifier; None without candidates."""
    spark = found.sparkSession
    counts = (found.select(F.explode(F.concat("_base", "_loose")).alias("s"))
              .groupBy(F.col("s.kind").alias("kind"), *[F.col(f"s.{x}").alias(x) for x in LABELERS])
              .count().collect())                          # kinds x 27 rows at most
    patterns = sorted(((r["kind"], *[r[x] for x in LABELERS]), r["count"]) for r in counts)
    if not patterns:
        return None
    rows = []
    for ((kind, *votes), n), q in zip(patterns, estimate(patterns)):
        x = [float(b) for b in _features(kind, votes)]
        rows += [(*x, 1.0, n * q), (*x, 0.0, n * (1 - q))]
    names = [f"x{i}" for i in range(len(rows[0]) - 2)]
    data = VectorAssembler(inputCols=names, outputCol="x").transform(
        spark.createDataFrame([r for r in rows if r[-1] > 0], [*names, "y", "w"]).coalesce(1))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=0.01, maxIter=50).fit(data)
    return float(model.intercept), [float(w) for w in model.coefficients]


def decided(found: DataFrame, model: tuple[float, list[float]] | None, least: float = 0.5) -> DataFrame:
    """Adds ``_spans``: base spans and the loose ones that the classifier
    takes, sorted by kind and start."""
    if model is None:
        return found.withColumn("_spans", F.array_sort("_base"))
    bias, weights = model

    def chance(s: Column) -> Column:
        x = _features(s["kind"], [s[v] for v in LABELERS])
        z = F.lit(bias)
        for w, on in zip(weights, x):
            z = z + F.when(on, w).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-z))

    return found.withColumn("_spans", F.array_sort(F.concat("_base", F.filter("_loose", lambda s: chance(s) >= least))))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets;
    overlapping spans become one.  A null text stays null."""
    found = candidates(boxed(docs, "text"))
    d = decided(found, fit(found))
    by_place = F.array_sort(F.transform("_spans", lambda s: F.struct(
        s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    zero = F.array().cast("array<struct<a:int,b:int,k:int>>")

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"), last["k"].alias("k"))
        return F.when((F.size(acc) > 0) & (s["a"] < F.get(acc, F.size(acc) - 1)["b"]),
                      F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    d = d.withColumn("_m", F.aggregate(by_place, zero, join))
    ends = F.concat(F.array(F.lit(0)), F.transform("_m", lambda s: s["b"]))
    kept = F.transform("_m", lambda s, i: F.concat(
        F.substring(F.col("text"), F.get(ends, i) + 1, s["a"] - F.get(ends, i)), F.get(names, s["k"])))
    tail = F.substring(F.col("text"), F.get(ends, F.size("_m")) + 1, F.length("text"))
    text = F.when(F.size("_m") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(F.col("text"))
    return unboxed(d, docs.columns, text=text)


def op1_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates(only(table(spark, sf_dir, "documents"), "doc_id", "text")).select("doc_id", "_base", "_loose")
    found = cut(found, "pii")                              # spans and votes only, no text
    d = decided(found, fit(found)).withColumn("_base", F.array_sort("_base"))
    counts = [F.size(_of_kind("_base", i)).cast("bigint").alias(f"n_{k}")
              for i, k in enumerate(KINDS)]
    return d.select("doc_id", *counts, F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"),
                    listed(F.col("_spans")).alias("spans"))
