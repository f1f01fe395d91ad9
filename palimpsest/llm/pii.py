r"""Personal data: pattern matches, and words that give a match away, in DataFrame functions only.

Base spans come from four patterns, leftmost and without overlap for each kind. The patterns are
written so that Java's matcher never runs over the same characters twice: a run is taken whole
(possessive) and only from its start, or from where the last match ended (\G). That finds the
same matches as the plain patterns named beside them, since a plain match can start within a run
only if it could have started with the run.

The method: each found value is a protected entity, each line of a text a context. A word t
discloses an entity e by the share of e's information that it carries,

    PMI(e; t) / IC(e) = log(p(e | t) / p(e)) / log(1 / p(e)),

with p(e | t) estimated from all contexts of t in the corpus and one more in which e is as likely
as anywhere, so a word seen once, beside an entity seen once, is judged too. Words at or above the threshold are spans of
their own in the documents that hold the entity; sanitise() generalises base spans to their kind
and removes such words. Counts cover all lines of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import Scratch

#: kind: (pattern, what a text has that holds a match)
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    # [0-9]([\x20-]?[0-9])+
    "card": (r"[0-9]++(?:[ -][0-9]++)*+", r"[0-9](?:[ -]?[0-9]){15}"),
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
KINDS = list(PATTERNS)
TERM = r"\p{L}++"
#: Share of an entity's information from which a word discloses it.
DISCLOSED = 0.9
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
SPANS = "array<struct<start:int,end:int,value:string>>"


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "email":
        return match.isNotNull()
    if kind == "ip":
        return match.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    luhn = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0
    return F.when(n.between(16, 19), luhn).otherwise(False)


def _spans(text: Column, pattern: str, valid) -> Column:
    """Matches with their places in code points: what lies between them comes from the split."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["match"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("value")))
        keep = x["match"].isNotNull() & valid(x["match"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPANS)
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the valid matches (start, end, value), by start."""
    none = F.array().cast(SPANS)
    return {
        kind: F.when(text.rlike(hint), _spans(text, pattern, lambda m, kind=kind: _valid(kind, m))).otherwise(none)
        for kind, (pattern, hint) in PATTERNS.items()
    }


def _entities(spans: list[tuple[str, Column]]) -> Column:
    """Distinct protected values: kind and value, digits alone for numbers."""
    def named(kind: str, col: Column) -> Column:
        def value(s: Column) -> Column:
            plain = F.lower(s["value"]) if kind in ("email", "ip") else F.regexp_replace(s["value"], "[^0-9]", "")
            return F.concat(F.lit(kind + ":"), plain)

        return F.transform(col, value)

    return F.array_distinct(F.concat(*[named(kind, col) for kind, col in spans]))


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(line, PATTERNS["email"][0], " ")), F.lit(TERM), F.lit(0)))


def detect(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosed: float = DISCLOSED
) -> DataFrame:
    """Per document: doc_id, text (null unless it has spans), email, ip, card, phone, term (arrays of start, end, value).

    Null is empty. Equal texts have equal spans; repeated rows stay, and count as contexts. A word
    within a base span is none. Other columns are not read; ids are not used.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "pii")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = docs.withColumns(base_spans(F.col("text")))
    some = F.greatest(*[F.size(k) for k in KINDS]) > 0
    base = scratch.keep(
        found.select("doc_id", F.xxhash64("text").alias("key"), *KINDS, F.when(some, F.col("text")).alias("text")), "base"
    )
    lines = base.where("text is not null").select("key", F.explode(F.split("text", "\n")).alias("line"))
    spans = base_spans(F.col("line"))
    held = lines.select("key", "line", _entities(list(spans.items())).alias("entities")).where(F.size("entities") > 0)
    held = scratch.keep(held, "lines")
    entity = held.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_e"))
    both = (
        held.select(F.explode("entities").alias("entity"), "line")
        .select("entity", F.explode(_terms(F.col("line"))).alias("term"))
        .groupBy("entity", "term")
        .agg(F.count("*").alias("n_both"))
    )
    all_lines = docs.select(F.explode(F.split("text", "\n")).alias("line"))
    term = all_lines.select(F.explode(_terms(F.col("line"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.sum(F.size(F.split("text", "\n")).cast("long"))).first()[0] or 0
    p_e = F.col("n_e") / F.lit(float(max(total, 1)))
    p_et = (F.col("n_both") + p_e) / (F.col("n_t") + 1)
    share = F.when(p_e < 1, F.log(p_et / p_e) / -F.log(p_e)).otherwise(0.0)
    gives = both.join(entity, "entity").join(term, "term").where(share >= disclosed).select("entity", "term")
    own = held.select("key", F.explode("entities").alias("entity")).distinct()
    words = scratch.keep(
        own.join(gives, "entity").groupBy("key").agg(F.collect_set("term").alias("terms")), "terms"
    )
    out = base.join(words, "key", "left")
    known = F.concat(*KINDS)
    token = _spans(F.col("text"), TERM, lambda m: F.array_contains(F.col("terms"), F.lower(m)))
    clear = F.filter(token, lambda s: ~F.exists(known, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    none = F.array().cast(SPANS)
    return out.select("doc_id", "text", *KINDS, F.when(F.col("terms").isNotNull(), clear).otherwise(none).alias("term"))


def _joined(kinds: list[str]) -> Column:
    def shown(kind: str) -> Column:
        return F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(shown, kinds)), ",")


def report(found: DataFrame) -> DataFrame:
    """detect() as counts and digests of the base spans, and all spans as a string."""
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(KINDS), 256).alias("base_sha256"),
        _joined([*KINDS, "term"]).alias("spans"),
    )


def sanitise(found: DataFrame) -> DataFrame:
    """doc_id and text of the documents with spans: matches become their kind, disclosing words are removed.

    Of spans of different kinds that overlap, the one that starts first stands for both.
    """
    kinds = [*KINDS, "term"]
    def labelled(kind: str) -> Column:
        label = F.lit("" if kind == "term" else f"[{kind}]")
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label")))

    all_ = F.array_sort(F.concat(*map(labelled, kinds)))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        skip = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(skip, acc["out"]).otherwise(F.concat(acc["out"], gap, s["label"])).alias("out")
        )

    done = F.aggregate(all_, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.substring(F.col("text"), done["at"] + 1, F.char_length("text"))
    return found.where("text is not null").select("doc_id", F.concat(done["out"], rest).alias("text"))
