"""Personal data: base patterns, and contexts bootstrapped from them. DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, text_hash

KINDS = ("email", "ip", "card", "phone")

# A match begins where no match could have begun earlier: at the first character of a run, or where the match before ended (\G). Possessive
# repeats never give back characters that the next part could not take, so each pattern takes time in proportion to the text.
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Runs of two or more digit groups with their separators on one line; else words that hold a digit or an @.
_BLANK = r"[ \t\u00A0]{1,3}+"
_GROUP, _TAIL = r"[(\[]*+[0-9][0-9()\[\]./-]*+", r"[\"'`)\]}>.,;:!?*]*+"
_RUN_OF_GROUPS = rf"[\"'`<{{(\[]*+\+?+{_GROUP}(?:{_BLANK}(?:[-./\u2013]{_BLANK})?+{_GROUP}(?={_TAIL}(?:\s|$)))++{_TAIL}"
_CANDIDATE = rf"(?:\G|(?<!\S))(?:{_RUN_OF_GROUPS}|[^\s0-9@]*+[0-9@]\S*+)"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: What a word must look like to be taken for a kind in a trusted context.
_SHAPES = {
    "email": "[A-Za-z0-9]@[A-Za-z0-9]",
    "ip": r"^[0-9A-Fa-f]{1,4}(?:[.:]{1,2}[0-9A-Fa-f]{1,4}){3,7}+$",
    "card": r"^(?:[0-9][0-9-]{10,30}|[0-9](?:[\s.\u2013-]{0,7}[0-9]){11,18})$",
    "phone": r"^(?:[+(]?[0-9][0-9().-]{6,20}|\+?[(\[]*[0-9](?:[\s()\[\]./\u2013-]{0,9}[0-9]){6,14})$",
}
_EDGES = "\"'`()[]{}<>.,;:!?*#$%&|="
#: What is cut off before a value: all edges, but not the bracket of an area code.
_LEAD = r"^(?:(?!\([0-9]++\)\s*+[0-9])[\"'`()\[\]{}<>.,;:!?*#$%&|=])*+"
#: Long arrays are worked on in runs of so many, and those in shorter ones.
_RUN, _FEW = 128, 8
ROUNDS, LEAST_SEEDS, TRUST, PRIOR = 3, 3, 0.7, 2.0


def _spans(text: Column, matches: Column, between: Column) -> Column:
    """(start, end, value) of matches, from the pieces of text before each; runs of matches are joined, as appending one by one copies all."""
    nothing = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")
    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["between"])
        end = begin + F.length(x["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def run(acc: Column, some: Column) -> Column:
        begin = F.struct(acc["at"].alias("at"), nothing.alias("out"))
        return F.aggregate(some, begin, step, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], x["out"]).alias("out")))

    pairs = F.zip_with(matches, F.slice(between, F.lit(1), F.size(matches)), lambda m, p: F.struct(m.alias("value"), p.alias("between")))
    def runs(all_pairs: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(all_pairs), F.lit(1)), F.lit(_RUN))
        return F.aggregate(F.transform(begins, lambda i: F.slice(all_pairs, i, F.lit(_RUN))), start, run, lambda acc: acc["out"])

    return F.get(F.transform(F.array(pairs), runs), F.lit(0))  # the pairs are made once


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "card":
        each = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))

        def luhn(d: Column, i: Column) -> Column:
            twice = F.coalesce(d, F.lit(0)) * (1 + i % 2)
            return twice - F.when(twice > 9, 9).otherwise(0)

        total = F.aggregate(F.transform(each, luhn), F.lit(0), lambda a, x: a + x.cast("int"))
        return F.when(F.length(digits).between(12, 19), total % 10 == 0).otherwise(False)
    return F.lit(True)


def _valid_in(kind: str):
    return lambda s: _valid(kind, s["value"])


def _numbered(number: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """The base matches of a text as array of (start, kind number, end), by start."""
    found = []
    for number, kind in enumerate(KINDS):
        pattern = _PATTERNS[kind]
        spans = _spans(text, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1))
        spans = F.transform(F.filter(spans, _valid_in(kind)), _numbered(number))
        there = text.rlike("[0-9]" if kind != "email" else "@") & text.contains(_NEEDS[kind])
        found.append(F.when(there, spans).otherwise(F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))
    return F.array_sort(F.concat(*found))


def _candidates(documents: DataFrame) -> DataFrame:
    """Adds `seen`: runs of digit groups and words that hold a digit or @, by their trimmed places, with the words around and the kind of a base span there.

    Contexts are whole words outside the run; another candidate among them is #, and ^ and $ stand for the text's ends. Words of a run are
    candidates too where they look like a kind that the run does not, with the run's contexts.
    """
    text = F.col("text")
    matched = documents.withColumn("m", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(_CANDIDATE), F.lit(0))))
    matched = matched.withColumn("p", F.when(F.col("m").isNotNull(), F.split(text, _CANDIDATE, -1)))
    matched = matched.withColumn("w", F.when(F.col("m").isNotNull(), _spans(text, F.col("m"), F.col("p"))))

    def trimmed(start: Column, value: Column) -> Column:
        lead = F.length(F.regexp_extract(value, _LEAD, 0))
        return F.struct((start + lead).alias("start"), F.rtrim(F.substring(value, lead + 1, F.length(value)), F.lit(_EDGES)).alias("value"))

    def placed(t: Column) -> list[Column]:
        # the end is kept, as counting a long value's characters for every span beside it takes long
        return [t["start"].alias("start"), (t["start"] + F.length(t["value"])).alias("end"), t["value"].alias("value")]

    def described(t: Column, patterns: Column, base: Column) -> Column:
        under = F.filter(base, lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"]))
        seed = F.get(under, F.lit(0))["kind"]
        return F.struct(t["start"].alias("start"), t["end"].alias("end"), t["value"].alias("value"), seed.alias("seed"), patterns.alias("patterns"))

    def contexts(i: Column) -> Column:
        before = F.when(i > 1, " # ").otherwise(" ^ ")
        left = F.concat(before, F.when(i > 0, F.concat(F.get("p", i - 1), F.lit(" # "))).otherwise(" ^ "), F.get("p", i))
        left = F.regexp_extract(F.reverse(F.lower(left)), r"^\s*+(\S++\s++\S++)", 1)  # read backwards
        right = F.concat(F.lower(F.get("p", i + 1)), F.when(i + 1 < F.size("w"), " #").otherwise(" $"))
        right = F.regexp_extract(right, r"^\s*+(\S++)", 1)
        return F.array(F.xxhash64(F.lit("before"), left), F.xxhash64(F.lit("around"), F.regexp_extract(left, r"^(\S++)", 1), right))

    looks = [lambda value, k=k: value.rlike(_SHAPES[k]) for k in KINDS]

    def words(run: Column, base: Column) -> Column:
        value, own = run["value"], run["looks"]
        parts = _spans(value, F.regexp_extract_all(value, F.lit(r"\S++"), F.lit(0)), F.split(value, r"\S++", -1))
        parts = F.transform(F.transform(parts, lambda x: trimmed(run["start"] + x["start"], x["value"])), lambda x: F.struct(*placed(x)))
        fits = F.filter(parts, lambda x: reduce(or_, [f(x["value"]) & ~F.get(own, F.lit(k)) for k, f in enumerate(looks)]))
        inner = F.filter(F.transform(fits, lambda x: described(x, run["patterns"], base)), lambda x: x["seed"].isNull())
        whole = F.array(described(run, run["patterns"], base))
        return F.when(value.rlike(r"\s"), F.concat(whole, inner)).otherwise(whole)

    def blocks(runs: Column, base: Column, size: int) -> Column:
        """The runs in blocks of `size`, each with the base spans that it touches, so that no run looks at all of a long text's."""
        begins = F.when(F.size(runs) > 0, F.sequence(F.lit(1), F.size(runs), F.lit(size))).otherwise(F.expr("cast(array() as array<int>)"))

        def touched(block: Column) -> Column:
            first, last = F.get(block, F.lit(0)), F.element_at(block, -1)
            near = F.filter(base, lambda b: (b["start"] < last["end"]) & (b["end"] > first["start"]))
            return F.struct(block.alias("runs"), near.alias("base"))

        return F.transform(F.transform(begins, lambda i: F.slice(runs, i, F.lit(size))), touched)

    def run(t: Column, i: Column) -> Column:
        return F.struct(*placed(t), F.array(*[f(t["value"]) for f in looks]).alias("looks"), contexts(i).alias("patterns"))

    runs = F.transform(F.transform("w", lambda s: trimmed(s["start"], s["value"])), run)
    matched = matched.withColumn("runs", F.filter(runs, lambda s: F.length(s["value"]) > 0))
    matched = matched.withColumn("large", blocks(F.col("runs"), F.col("base"), _RUN))
    matched = matched.withColumn("small", F.flatten(F.transform("large", lambda x: blocks(x["runs"], x["base"], _FEW))))
    seen = F.transform("small", lambda x: F.flatten(F.transform(x["runs"], lambda r: words(r, x["base"]))))
    return matched.withColumn("seen", F.flatten(seen)).drop("m", "p", "w", "runs", "large", "small")


def trusted_patterns(
    mentions: DataFrame, rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, trust: float = TRUST, prior: float = PRIOR
) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are trusted; `mentions`: (pattern, value, seed).

    A pattern is a context; an instance is a word or run seen in it. Seeds (those that touch base spans) have confidence 1 for their kind, others that look
    like a kind start at 0. In each round a pattern's confidence for a kind is the sum of its instances' over their number and `prior`;
    an unlabelled instance takes the mean of its patterns'. Only patterns with `least_seeds` different seeds of a kind stay in the graph.
    """
    kinds = F.array(*[F.when(F.col("value").rlike(_SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS)])
    edges = mentions.groupBy("pattern", F.xxhash64("value").alias("v")).agg(
        F.max("seed").alias("seed"), F.first(F.when(F.col("seed").isNull(), F.array_compact(kinds))).alias("kinds")
    )
    edges = stored(edges, "edges")
    seeded = edges.filter("seed is not null").groupBy("pattern", F.col("seed").alias("kind")).agg(F.count("*").alias("seeds"))
    seeded = stored(seeded.filter(F.col("seeds") >= least_seeds), "seeded")
    edges = stored(edges.join(seeded.select("pattern").distinct(), "pattern", "left_semi"), "edges")
    total = edges.groupBy("pattern").agg(F.count("*").alias("total"))
    labels = F.when(F.col("seed").isNotNull(), F.array(F.struct(F.col("seed").alias("kind"), F.lit(1.0).alias("fixed"))))
    labels = labels.otherwise(F.transform("kinds", lambda k: F.struct(k.alias("kind"), F.lit(0.0).alias("fixed"))))
    instances = edges.select("v", F.explode(labels).alias("l")).groupBy("v", "l.kind").agg(F.max("l.fixed").alias("fixed"))
    instances = stored(instances, "instances")
    confidence = instances.withColumn("c", F.col("fixed"))
    for _ in range(rounds):
        scored = edges.join(confidence, "v").groupBy("pattern", "kind").agg(F.sum("c").alias("c"))
        scored = scored.join(total, "pattern").join(seeded, ["pattern", "kind"], "left_semi")
        scored = stored(scored.select("pattern", "kind", (F.col("c") / (F.col("total") + prior)).alias("confidence")), "patterns")
        heard = edges.join(scored, "pattern").groupBy("v", "kind").agg(F.avg("confidence").alias("heard"))
        confidence = instances.join(heard, ["v", "kind"], "left")
        confidence = confidence.select("v", "kind", "fixed", F.greatest("fixed", F.coalesce("heard", F.lit(0.0))).alias("c"))
    return scored.filter(F.col("confidence") >= trust)


def personal_data(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS, trust: float = TRUST
) -> DataFrame:
    """Per document (id, base, found): arrays of (start, kind, end) by start, in code points, `kind` an index of KINDS.

    `base` has the matches of the base patterns. Their contexts (the two words before; the word before with the word behind) are patterns; in those
    that `trusted_patterns` trusts, words and runs of digit groups that look like the kind and touch no base span are `found`. A null text counts as empty. Rows
    with equal id and text have equal results, one output row per input row.

    The texts are read once and not shuffled; what is shuffled are words with digits and their contexts, combined per context and word
    first. A context that is very frequent is a few combined rows; the join of its mentions with the trusted ones has
    an exchange on either side, which adaptive execution can split.
    """
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("th", text_hash(F.col("text"))).withColumn("base", base_spans(F.col("text")))
    rows = stored(_candidates(rows).select("id", "th", "base", "seen"), "mentions")
    mention = rows.filter(F.size("seen") > 0).select("id", "th", F.explode("seen").alias("s")).select("id", "th", "s.*")
    mention = mention.withColumn("pattern", F.explode("patterns")).drop("patterns")
    trusted = trusted_patterns(mention.select("pattern", "value", "seed"), rounds, least_seeds, trust)
    fits = F.element_at(F.array(*[F.col("value").rlike(_SHAPES[k]) for k in KINDS]), F.col("kind") + 1)
    found = mention.filter("seed is null").join(stored(trusted.select("pattern", "kind"), "trusted"), "pattern").filter(fits)
    found = found.groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("found"))
    joined = rows.select("id", "th", "base").join(
        found.select(F.col("id").alias("fid"), F.col("th").alias("fth"), "found"), F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left"
    )
    nothing = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    return joined.select(F.col("id").alias(id_col), "base", F.coalesce("found", nothing).alias("found"))


def of_kind(kind: str):
    """Whether a span is of the kind."""
    return lambda s: s["kind"] == KINDS.index(kind)


def spelled(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    each = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")
