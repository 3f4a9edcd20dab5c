"""Secret scans with DataFrame functions: fixed formats, and random strings told apart by character Markov models.

Two first-order Markov models of characters, one of random strings and one of ordinary identifiers, are counted from
labelled samples by a Spark aggregation. Every token of 12 characters or more that fixed formats don't cover whole is
scored by its log-likelihood ratio; above the threshold, which depends on its length and mix of characters, it is a
span of kind `random`.

Cases: a null text counts as empty (no spans); overlapping spans of different kinds are all listed and redacted as one
place; a score right on the threshold counts as random; a very long text or token is one row, its time grows with its
length; repeated rows give repeated results; an empty table gives an empty table; other columns pass by whatever their
names are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import bind, unused
from tracelake.llm.spans import SPAN, in_blocks, match_spans, replace_spans, runs

#: Kinds in their order, pattern, the group whose size counts, and its least size.
KINDS = [
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Tokens that the models judge.
LEAST, LONG = 12, 20
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Nats beyond the threshold that a token needs in all: none if long and with a digit; shorter with letters and digits;
#: letters with capitals inside; else words and numbers, which are the usual case by far.
NEEDS_MIXED, NEEDS_CAPITALS, NEEDS_PLAIN = 8.0, 12.0, 40.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
THRESHOLD = 0.35  # nats per step
MASK = "[SECRET]"

#: Parts of ordinary identifiers, for the default samples.
PARTS = (
    "get set add new old user name item list file path data table index count total first last next start end time date "
    "value key map node edge text word line page link image video model train test batch step loss rate config option "
    "request response handler service client server account order customer product invoice payment address number status "
    "version release build deploy cluster partition shuffle broadcast session window stream event message queue topic"
)


def default_samples(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled strings (text, random): digests in several alphabets, and identifiers put together from ordinary parts."""
    ids = spark.range(n, numPartitions=2).withColumn("d", F.sha2(F.col("id").cast("string"), 256))
    packed = F.base64(F.unhex("d"))
    random = F.element_at(F.array(F.col("d"), F.substring(packed, 1, 40), F.upper(F.substring("d", 1, 32)), F.regexp_replace(packed, "[+/=]", "")), (F.col("id") % 4 + 1).cast("int"))
    words = F.split(F.lit(PARTS), " ")
    part = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.size(words).cast("bigint")) + 1).cast("int"))
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(2100)).cast("string")
    plain = F.element_at(
        F.array(
            F.concat_ws("_", part(1), part(2), part(3), number),
            F.concat_ws("-", part(1), part(2), part(3), part(4), number),
            F.concat(part(1), F.initcap(part(2)), F.initcap(part(3)), F.initcap(part(4)), number),
            F.concat_ws("/", part(1), part(2), part(3), F.concat(part(4), number)),
            F.concat(F.upper(F.concat_ws("_", part(1), part(2), part(3))), F.lit("_"), number),
        ),
        (F.col("id") % 5 + 1).cast("int"),
    )
    return ids.select(random.alias("text"), F.lit(True).alias("random")).unionByName(ids.select(plain.alias("text"), F.lit(False).alias("random")))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio, random over ordinary, of each step from one character of ALPHABET to the next, row by row."""
    steps = samples.where(F.col("text").isNotNull()).select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("text") - 1, F.lit(1))), lambda i: F.substring(F.col("text"), i, F.lit(2)))).alias("pair"))
    counts = {(r.random, r.pair): r["count"] for r in steps.where(F.char_length("pair") == 2).groupBy("random", "pair").count().collect() if set(r.pair) <= set(ALPHABET)}
    table = []
    for a in ALPHABET:
        rows = {k: sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in (True, False)}
        for b in ALPHABET:
            p, q = ((counts.get((k, a + b), 0) + 0.5) / (rows[k] + 0.5 * len(ALPHABET)) for k in (True, False))
            table.append(math.log(p / q))
    return table


def markov_total(token: Column, table: list[float]) -> Column:
    """Sum of the log-likelihood ratios of a token's steps; its characters are all in ALPHABET, two at least."""
    ratios = F.split(F.lit(" ".join(f"{x:.6f}" for x in table)), " ").cast("array<double>")
    places = F.slice(F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), F.lit(1), F.char_length(token))
    start = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("sum"))
    step = lambda s, c: F.struct(c.alias("at"), (s["sum"] + F.when(s["at"] >= 0, F.get(ratios, s["at"] * len(ALPHABET) + c)).otherwise(0.0)).alias("sum"))
    return F.aggregate(places, start, step, lambda s: s["sum"])


def looks_random(token: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    """Whether the models judge a token random; in short or digitless ones a run of marks counts as one mark."""
    digit, letter, inside = token.rlike("[0-9]"), token.rlike("[A-Za-z]"), token.rlike("[a-z][A-Z]")
    need = F.when(digit & letter, NEEDS_MIXED).when(inside, NEEDS_CAPITALS).otherwise(NEEDS_PLAIN)
    tight = F.regexp_replace(token, "([+/_=-])[+/_=-]+", "$1")
    enough = lambda t, more: markov_total(t, table) >= threshold * (F.char_length(t) - 1) + more
    return F.when(digit & (F.char_length(token) >= LONG), enough(token, F.lit(0.0))).when(F.char_length(tight) >= LEAST, enough(tight, need)).otherwise(False)


def uncovered(found: Column, base: Column) -> Column:
    """Those of found that base, which is sorted by start too, does not cover whole: array of start, end.

    Both lists are merged: a span is covered if the run of base spans that began last reaches its end.
    """
    none = F.array().cast(SPAN)
    part = lambda x, rank: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"))
    both = F.array_sort(F.concat(F.transform(runs(base), lambda x: part(x, 0)), F.transform(found, lambda x: part(x, 1))))

    def step(s: Column, x: Column) -> Column:
        stays = F.when((x["rank"] == 1) & (x["end"] > s["reach"]), F.concat(s["out"], F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))).otherwise(s["out"])
        return F.struct(F.when(x["rank"] == 0, x["end"]).otherwise(s["reach"]).alias("reach"), stays.alias("out"))

    def block(s: Column, of: Column) -> Column:
        done = F.aggregate(of, F.struct(s["reach"].alias("reach"), none.alias("out")), step)
        return bind(done, lambda d: F.struct(d["reach"].alias("reach"), F.concat(s["out"], F.array(d["out"])).alias("out")))

    empty = F.struct(F.lit(-1).alias("reach"), F.array(none).alias("out"))
    return bind(both, lambda of: F.flatten(F.aggregate(in_blocks(of), empty, block)["out"]))


def spans(text: Column, table: list[float], threshold: float = THRESHOLD) -> Column:
    """All spans of a text, sorted: array of start, rank of the kind, kind, end."""
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    at_least = lambda n: lambda s: s["group"] >= n
    shape = lambda rank, kind: lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"))
    found = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        kept = F.filter(match_spans(text, F.lit(pattern), group), at_least(least))
        found.append(F.when(text.rlike(pattern), F.transform(kept, shape(rank, kind))).otherwise(none))
    likely = F.filter(match_spans(text, F.lit(TOKEN)), lambda s: looks_random(s["word"], table, threshold))
    more = lambda base: F.transform(uncovered(likely, base), shape(len(KINDS), "random"))
    return bind(F.array_sort(F.concat(*found)), lambda base: F.when(text.rlike(TOKEN), F.array_sort(F.concat(base, more(base)))).otherwise(base))


def scan(docs: DataFrame, text: str = "text", to: str = "__spans", table: list[float] | None = None, samples: DataFrame | None = None) -> DataFrame:
    """docs with the column `to`: the secrets of each whole text.

    The models come from `samples` (text, random), labelled strings of the caller's, or from the default ones; a table
    that was trained before can be given instead.
    """
    table = table or train(default_samples(docs.sparkSession) if samples is None else samples)
    scanned = unused("scanned", docs)
    return docs.withColumn(scanned, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(to, spans(F.col(scanned), table)).drop(scanned)


def report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    scanned = scan(docs.select("doc_id", "text")).select("doc_id", "__spans")
    count = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == kind)).cast("bigint")
    text = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(F.filter("__spans", lambda s: s["rank"] < len(KINDS))), 256).alias("base_sha256"),
        text(F.col("__spans")).alias("spans"),
        count("random").alias("n_random"),
    )


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", samples: DataFrame | None = None) -> DataFrame:
    """docs with each secret in the text replaced by a mark, and the length, if there is such a column, put right."""
    to = unused("spans", docs)
    found = scan(docs, text, to, samples=samples).withColumn(text, F.when(F.size(to) > 0, replace_spans(F.col(f"`{text}`"), F.col(to), MASK)).otherwise(F.col(f"`{text}`")))
    if length in docs.columns:
        found = found.withColumn(length, F.when(F.size(to) > 0, F.char_length(F.col(f"`{text}`")).cast(docs.schema[length].dataType)).otherwise(F.col(f"`{length}`")))
    return found.drop(to)
