"""Personal data: fixed patterns, and identifiers that bootstrapped contexts add (DataFrame functions only).

The fixed patterns give seed instances. The word before an instance is its context pattern; contexts and instance values form
a bipartite graph with looser candidate spans. Rounds of two aggregations score it: a context by the share of its
instances that are believed, over all documents; a value by the contexts it occurs in. Values that a round comes to believe count
as seeds in the next, so they induce contexts in turn. Candidates in contexts of high confidence and enough distinct seeds are
added to the spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Stage

KINDS = ("email", "ip", "card", "phone")

# The patterns whose matches are the base. Quantifiers are possessive and starts are tied to the run's start
# where that can't change a match, so long runs cost linear time and no deep stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# What a context may add: spelt-out addresses, IPv6 addresses, long numbers that fail the check digit, numbers without a prefix.
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[(\[]at[)\]] ?| at )[A-Za-z0-9-]{1,64}(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[A-Za-z0-9-]{2,64}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}

ROUNDS = 3
MIN_CONFIDENCE = 0.8
MIN_SEEDS = 3

_SPAN = "array<struct<start:int,kind:int,end:int,value:string,left:string>>"


def _digits(x: Column) -> Column:
    return F.translate(x, " -().+", "")


def _luhn(x: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(x)), ""), lambda d: d != "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int") + 1)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(_digits(x)).between(14, 19), _luhn(x)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(10, 15)
    return F.lit(True)


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """All matches, in code points, with the last word before each (lower case; '' if there is none within 40 characters)."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        gap, value = pair["gap"], pair["value"]
        begin = state["at"] + F.length(gap)
        end = begin + F.length(value)
        left = F.lower(F.regexp_extract(F.right(gap, F.lit(40)), r"(\p{L}+)[^\p{L}\n]*$", 1))
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), value.alias("value"), left.alias("left"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(g.alias("gap"), v.alias("value")))
    return F.aggregate(pairs, start, step, lambda s: s["out"])


def _detect(docs: DataFrame) -> DataFrame:
    """(id, base, loose): spans of the fixed patterns, and candidates that overlap none of them."""
    none = F.array().cast(_SPAN)
    text = F.col("text")
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9]"), "card": text.rlike("[0-9]"), "phone": F.contains(text, F.lit("+"))}
    loosely = {"email": text.rlike(r"[(\[ ]at[)\] ]"), "ip": F.contains(text, F.lit(":")), "card": may["card"], "phone": may["card"]}

    def valid(kind: str):
        return lambda s: _valid(kind, s["value"])

    base = F.concat(*[F.when(may[k], F.filter(_spans(text, PATTERNS[k], i), valid(k))).otherwise(none) for i, k in enumerate(KINDS)])
    loose = F.concat(*[F.when(loosely[k], _spans(text, CANDIDATES[k], i)).otherwise(none) for i, k in enumerate(KINDS)])
    found = docs.select("id", base.alias("base"), loose.alias("loose"))
    clear = F.filter("loose", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return found.select("id", F.sort_array("base").alias("base"), clear.alias("loose"))


def _contexts(found: DataFrame, rounds: int, min_confidence: float, min_seeds: int) -> DataFrame:
    """(kind, left) of the contexts to trust."""

    def edges(column: str, seed: int) -> DataFrame:
        spans = found.select(F.explode(column).alias("s")).where("s.left <> ''")
        return spans.groupBy("s.kind", "s.left", F.xxhash64("s.value").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.lit(seed).alias("seed"))

    graph = Stage(edges("base", 1).unionAll(edges("loose", 0)), "pii-graph").read()
    scored = graph.withColumn("belief", F.col("seed").cast("double"))
    for k in range(rounds):
        patterns = scored.groupBy("kind", "left").agg((F.sum("belief") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.count(F.when(F.col("belief") >= min_confidence, 1)).alias("seeds"))
        if k == rounds - 1:
            break
        patterns = patterns.withColumn("trust", F.when(F.col("seeds") >= min_seeds, F.col("confidence")).otherwise(0.0))
        doubt = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))))
        values = graph.join(patterns, ["kind", "left"]).groupBy("kind", "value").agg(F.greatest(F.max("seed"), 1 - doubt).alias("belief"))
        scored = Stage(graph.join(values, ["kind", "value"]), "pii-beliefs").read()
    return Stage(patterns.where((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds)).select("kind", "left"), "pii-contexts").read()


def _text_of(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base, added, base_sha256, spans)``, one row per input row.

    ``base`` and ``added`` are arrays of (start, kind, end, value, left) in code points, end exclusive, by start and kind; the
    counts and the digest are of ``base``; ``spans`` lists both. Null texts are empty; rows with null or repeated ids count
    as any other; other columns are ignored. An empty table gives an empty result."""
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = Stage(_detect(docs), "pii").read().withColumn("row", F.xxhash64("id", "base", "loose"))
    trusted = _contexts(found, rounds, min_confidence, min_seeds)
    loose = found.where(F.size("loose") > 0).select("row", F.explode("loose").alias("s")).withColumns({"kind": F.col("s.kind"), "left": F.col("s.left")})
    added = loose.join(trusted, ["kind", "left"]).groupBy("row").agg(F.sort_array(F.collect_set("s")).alias("added"))
    joined = found.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast(_SPAN)))

    def of_kind(i: int):
        return lambda s: s["kind"] == i

    counts = [F.size(F.filter("base", of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return joined.select(
        F.col("id").alias(id_col), *counts, "base", "added", F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(F.sort_array(F.concat("base", "added"))).alias("spans")
    )
