"""Secret scans with corpus-wide ownership frequency.

Candidates are found by fixed patterns. The value of each is hashed; over the
whole corpus, a value is counted by distinct repositories and distinct owners:
first reduced to one row for each (value, owner, repository), then for each
(value, owner), then for each value, so no value's occurrences meet in one task.
A value is a copied example if at least ``WIDE_OWNERS`` owners hold it, or two owners
in at least ``WIDE_REPOSITORIES`` repositories; any other is a live-looking
credential of its owners. One owner alone never makes an example, in however many
repositories it stands.

Base kinds (assign, access, hex) always stay. Further kinds are spans of their
own only while live-looking and outside every base span and kind before.

Only DataFrame operations. Places come from the pieces that a text falls into
when it is split at the matches: a match starts where the pieces and matches
before it end. Running sums and maxima go in blocks, so a text with very many
matches costs little more than in proportion to them.

Defined results: a null or empty text has no spans; null owners are one owner;
rows are judged one by one, repeated rows alike (they are one owner's); of equal
starts the kind listed first comes first; texts of any length are read whole; an
empty table gives an empty result; only doc_id, text and what owner and repository
read matter, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WIDE_OWNERS, WIDE_REPOSITORIES = 3, 6
RUN = 256


@dataclass(frozen=True)
class Kind:
    """group: of the value that is hashed; least: its least length; need: patterns
    that the value must also hold; hint: what every match holds, in plain letters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    need: tuple[str, ...] = ()
    hint: str = ""


#: Kinds of the contract. Runs of 24 hex digits or AKIA and 16 more are the runs
#: of any length that are long enough, as a shorter run can't hold a longer one.
BASE = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", hint="AKIA"),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{24,}"),
)

MORE = (
    Kind("bearer", r"(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{20,})", 1, 20, (r"[0-9]",)),
    Kind("forge", r"gh[oprsu]_[A-Za-z0-9]{30,}", hint="gh"),
    Kind("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Kind("block", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32,}={0,2}", 0, 32, (r"[0-9]", r"[a-z]", r"[A-Z]")),
)


def running(values: Column, start: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an array, ``op`` over ``start`` and all entries before it. An
    array that grows in a fold is copied at each step, so it grows within runs of
    ``RUN`` entries, and from run to run."""

    def scan(entries: Column, first: Column) -> Column:
        zero = F.struct(first.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct(op(acc["at"], x).cast("bigint").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(entries, zero, step, lambda acc: acc["out"])

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / RUN).cast("int")), lambda i: F.slice(values, i * RUN + 1, RUN))
    totals = F.transform(runs, lambda run: F.aggregate(run, start.cast("bigint"), lambda acc, x: op(acc, x).cast("bigint")))
    found = F.flatten(F.zip_with(runs, scan(totals, start), scan))
    return F.when(F.size(values) > 0, found).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, kind: Kind) -> Column:
    """array<struct(gap, width, value)>: the matches, each with the length of the text
    since the one before; null where there is none."""
    whole = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = whole if kind.group == 0 else F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group))
    pieces = F.slice(F.split(text, kind.pattern, -1), 1, F.size(whole))
    found = F.arrays_zip(F.transform(pieces, lambda p: F.length(p).cast("bigint")).alias("gap"), F.transform(whole, lambda w: F.length(w).cast("bigint")).alias("width"), value.alias("value"))
    hit = F.regexp_like(text, F.lit(kind.pattern))
    return F.when(F.contains(text, F.lit(kind.hint)) & hit if kind.hint else hit, found)


def spans(found: Column, kind: Kind) -> Column:
    """matches -> array<struct(start, end, value)>, in code points; matches that fail
    the kind's conditions are left out."""
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def ok(v: Column) -> Column:
        good = F.length(v) >= kind.least
        for pattern in kind.need:
            good = good & F.regexp_like(v, F.lit(pattern))
        return good

    before = running(F.transform(found, lambda m: m["gap"] + m["width"]), F.lit(0), lambda a, b: a + b)
    placed = F.zip_with(found, before, lambda m, at: F.struct((at + m["gap"]).alias("start"), (at + m["gap"] + m["width"]).alias("end"), m["value"].alias("value")))
    return F.when(found.isNotNull(), F.filter(placed, lambda x: ok(x["value"]))).otherwise(nothing)


def merged(taken: Column, more: Column) -> Column:
    """Two arrays of spans as one, by start, each with whether it is of ``more``."""
    tagged = lambda spans_, later: F.transform(spans_, lambda x: F.struct(x["start"].alias("start"), F.lit(later).alias("later"), x["end"].alias("end"), x.alias("span")))
    return F.array_sort(F.concat(tagged(taken, False), tagged(more, True)))


def free(both: Column) -> Column:
    """merged -> the later spans that touch none of the others: all others that start
    no later have ended, and the next one starts no earlier than it ends."""
    far = (1 << 62) - 1
    ended = running(F.transform(both, lambda e: F.when(e["later"], F.lit(0)).otherwise(e["end"])), F.lit(0), F.greatest)
    begins = F.reverse(running(F.reverse(F.transform(both, lambda e: F.when(e["later"], F.lit(far)).otherwise(e["start"]))), F.lit(far), F.least))
    zipped = F.arrays_zip(both.alias("e"), ended.alias("ended"), begins.alias("begins"))
    return F.transform(F.filter(zipped, lambda z: z["e"]["later"] & (z["ended"] <= z["e"]["start"]) & (z["begins"] >= z["e"]["end"])), lambda z: z["e"]["span"])


def _listed(found: Column) -> Column:
    """kind:start:end of each span (sorted by start, then kind as listed), joined by commas."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def candidates(docs: DataFrame, owner: Column, repository: Column, base=BASE, more=MORE) -> DataFrame:
    """One row for each row of docs: row_id, doc_id, owner, repository and spans
    array<struct(start, order, end, kind, base, hash)>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kinds = (*base, *more)
    # each step is a column of its own, so that it is worked out once
    rows = docs.select(F.col("doc_id"), owner.alias("owner"), repository.alias("repository"), *[matches(text, k).alias(f"m{i}") for i, k in enumerate(kinds)])
    rows = rows.select("doc_id", "owner", "repository", *[spans(F.col(f"m{i}"), k).alias(f"s{i}") for i, k in enumerate(kinds)])

    def named(i: int, kind: Kind) -> Column:
        one = lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("order"), x["end"].alias("end"), F.lit(kind.name).alias("kind"), F.lit(i < len(base)).alias("base"), F.unhex(F.sha2(x["value"], 256)).alias("hash"))
        return F.transform(f"s{i}", one)

    rows = rows.select("doc_id", "owner", "repository", *[named(i, k).alias(f"s{i}") for i, k in enumerate(kinds)])
    rows = rows.withColumn("found", F.concat(*[F.col(f"s{i}") for i in range(len(base))]))
    for i in range(len(base), len(kinds)):
        meet = (F.size(f"s{i}") > 0) & (F.size("found") > 0)
        rows = rows.withColumn("both", F.when(meet, merged(F.col("found"), F.col(f"s{i}"))))
        rows = rows.withColumn("found", F.concat("found", F.when(meet, free(F.col("both"))).otherwise(F.col(f"s{i}"))))
    # an id for each row, so that rows with one doc_id stay apart; written, so that it stays the same
    return rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "owner", "repository", F.col("found").alias("spans"))


def ownership(spans_: DataFrame) -> DataFrame:
    """spans (hash, owner, repository) -> hash, n_owners, n_repositories, n_places."""
    each = spans_.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    owners = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n_repositories"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n_repositories").alias("n_repositories"), F.sum("n").alias("n_places"))


def scan(docs: DataFrame, owner: Column, repository: Column, wide_owners: int = WIDE_OWNERS, wide_repositories: int = WIDE_REPOSITORIES, base=BASE, more=MORE) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_<kind> of each base kind, base_sha256, spans, n_live,
    n_copied, and the most owners and repositories of a value in the text: one row
    for each row of docs."""
    rows = stored(candidates(docs, owner, repository, base, more), "secret-spans")
    flat = rows.select("row_id", "owner", "repository", F.explode("spans").alias("span")).select("*", "span.hash")
    copied = (F.col("n_owners") >= wide_owners) | ((F.col("n_owners") >= 2) & (F.col("n_repositories") >= wide_repositories))
    values = ownership(flat).withColumn("copied", copied)
    judged = flat.join(values, "hash").select("row_id", F.struct("span.start", "span.order", "span.end", "span.kind", "span.base", "copied").alias("x"), "n_owners", "n_repositories")
    judged = judged.groupBy("row_id").agg(F.sort_array(F.collect_list("x")).alias("x"), F.max("n_owners").alias("most_owners"), F.max("n_repositories").alias("most_repositories"))
    rows = rows.select("row_id", "doc_id").join(judged, "row_id", "left")
    rows = rows.withColumn("x", F.coalesce("x", F.filter(F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.lit(0).alias("order"), F.lit(0).cast("bigint").alias("end"), F.lit("").alias("kind"), F.lit(False).alias("base"), F.lit(False).alias("copied"))), lambda x: x["base"])))
    kinds = F.col("x.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k.name))).cast("long").alias(f"n_{k.name}") for k in base]
    return rows.select(
        "doc_id",
        *counts,
        F.sha2(_listed(F.filter("x", lambda x: x["base"])), 256).alias("base_sha256"),
        _listed(F.filter("x", lambda x: x["base"] | ~x["copied"])).alias("spans"),
        F.size(F.filter("x", lambda x: ~x["copied"])).cast("long").alias("n_live"),
        F.size(F.filter("x", lambda x: x["copied"])).cast("long").alias("n_copied"),
        F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"),
        F.coalesce("most_repositories", F.lit(0)).cast("long").alias("most_repositories"),
    )
