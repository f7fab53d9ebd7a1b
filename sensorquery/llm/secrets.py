"""Secret scans: fixed rules, and character Markov models for what the rules do not name.

The rules give the base spans. Beyond them, every run of at least RUN_LENGTH base-64 characters is
scored by two character Markov models, one of random strings and one of ordinary identifiers: the
log-likelihood ratio of its characters, each given the one before. Runs above both thresholds that
touch no base span are added. Both models are trained on labelled samples from the documents: what
the rules found is random, the letters and underscores of ordinary words are identifiers.

DataFrame functions only. Null texts count as empty and have no spans; positions are code points,
ends exclusive; repeated rows each give their row; extra columns are not looked at. Rows are worked
on one by one, so no key can be hot. A model holds a fixed alphabet squared, whatever the corpus.
Building positions costs the square of a text's matches; matches are few even in long texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the base spans, in the order in which kinds are listed.
ASSIGN = (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LENGTH = 6
KINDS = ("assign", "access", "hex", "markov")

RUN_LENGTH = 20
RUN = rf"[A-Za-z0-9+/_=-]{{{RUN_LENGTH},}}"
WORD = r"[A-Za-z_]{4,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_DOCS = 4000  # expected documents of the training sample
SAMPLE_WORDS = 200  # words taken from each of them
LEAST_RATIO, LEAST_MEAN = 12.0, 0.5  # of the whole run, and per character
_SPAN = "struct<start:int,kind:int,end:int,text:string>"


def _none() -> Column:
    return F.from_json(F.lit("[]"), f"array<{_SPAN}>")


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost matches that do not overlap, as (start, kind, end, text). A text is a chain of gap,
    match, gap, ..., gap; positions are the running sum of their lengths."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    start = F.struct(F.lit(0).alias("at"), _none().alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + pair["gap"]
        end = begin + F.char_length(pair["text"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["text"].alias("text"))
        return F.struct(end.alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("text"))
    return F.when(text.rlike(pattern), F.aggregate(pairs, start, step, lambda acc: acc["spans"])).otherwise(_none())


def with_base_spans(docs: DataFrame) -> DataFrame:
    """Adds ``base``: the spans of the three rules, by start, then kind."""
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(
        matches(text, ASSIGN, 0), lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_LENGTH
    )
    access = F.when(text.contains("AKIA"), matches(text, ACCESS, 1)).otherwise(_none())
    return docs.withColumn("base", F.array_sort(F.concat(assign, access, matches(text, HEX, 2))))


def _index(char: Column) -> Column:
    """Place of an ASCII character in the alphabet, 0 for any other."""
    table = [0] * 128
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 1
    return F.array(*map(F.lit, table))[F.least(F.ascii(char), F.lit(127))]


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios (random against identifier) of each character given the one before, row
    by row; row 0 is the beginning. Counts come from a sample of about SAMPLE_DOCS documents chosen
    by a hash of their id; every pair is smoothed with one half."""
    every = max(1, docs.count() // SAMPLE_DOCS)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = with_base_spans(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0))
    secret = F.transform("base", lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["text"], ASSIGN, 2)).otherwise(s["text"]))
    plain = F.slice(F.regexp_extract_all(F.regexp_replace("text", RUN, " "), F.lit(WORD), F.lit(0)), 1, SAMPLE_WORDS)
    strings = chosen.select(F.explode(secret).alias("s")).select("s", F.lit(1).alias("random")).unionByName(
        chosen.select(F.explode(plain).alias("s")).select("s", F.lit(0).alias("random"))
    )
    places = F.sequence(F.lit(1), F.char_length("s"))
    pairs = strings.where("s <> ''").select("random", "s", F.explode(places).alias("i")).select(
        "random",
        F.when(F.col("i") == 1, F.lit(0)).otherwise(_index(F.substring("s", F.col("i") - 1, F.lit(1)))).alias("a"),
        _index(F.substring("s", F.col("i"), F.lit(1))).alias("b"),
    )
    n = len(ALPHABET) + 1
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.groupBy("random", "a", "b").agg(F.count("*").alias("n")).collect()}
    out = []
    for a in range(n):
        row = {k: [counts.get((k, a, b), 0) + 0.5 for b in range(n)] for k in (0, 1)}
        total = {k: math.log(sum(row[k])) for k in (0, 1)}
        out += [math.log(row[1][b]) - total[1] - math.log(row[0][b]) + total[0] for b in range(n)]
    return out


def ratio(run: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a string under the two models."""
    n = len(ALPHABET) + 1
    table = F.array(*map(F.lit, model))
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, char: Column) -> Column:
        here = _index(char)
        return F.struct(here.alias("last"), (acc["sum"] + F.get(table, acc["last"] * n + here)).alias("sum"))

    return F.aggregate(F.split(run, ""), start, step, lambda acc: acc["sum"])


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """Adds ``base`` and ``spans`` (base and added spans by start, then kind) to every row; columns of
    these names, and ``_runs``, are replaced. ``redact`` keeps all columns."""
    model = train(docs) if model is None else model
    text = F.coalesce("text", F.lit(""))
    found = with_base_spans(docs).withColumn("_runs", matches(text, RUN, 3))
    free = F.filter("_runs", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))

    def random(run: Column) -> Column:
        score = ratio(run["text"], model)
        return score >= F.greatest(F.lit(LEAST_RATIO), LEAST_MEAN * F.char_length(run["text"]))

    return found.withColumn("spans", F.array_sort(F.concat("base", F.filter(free, random)))).drop("_runs")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    found = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def number(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", model: list[float] | None = None) -> DataFrame:
    """The rows of ``docs`` with every span (overlapping ones together) replaced by ``mask``; a null
    text stays null and ``n_chars``, where there is one, follows the new text. All other columns travel
    in a struct, so whatever their names they come back as they were."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
    found = scan(packed, train(docs) if model is None else model)
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] + 1 >= acc["at"]
        gap = F.substring(F.col("text"), acc["at"], F.greatest(F.lit(0), s["start"] + 1 - acc["at"]))
        return F.struct(
            F.greatest(acc["at"], s["end"] + 1).alias("at"),
            F.when(fresh, F.concat(acc["out"], gap, F.lit(mask))).otherwise(acc["out"]).alias("out"),
        )

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"], F.char_length("text")))
    hit = F.size("spans") > 0
    masked = found.select("row", F.when(hit, F.aggregate("spans", start, step, end)).otherwise(F.col("text")).alias("text"), hit.alias("hit"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        kept = F.col(f"row.`{c}`")
        if c == "n_chars":
            kept = F.when(F.col("hit"), F.char_length("text").cast("long")).otherwise(kept)
        return kept.alias(c)

    return masked.select(*[column(c) for c in docs.columns])
