"""Secrets in texts, told from copied examples by how many owners have them.

Base spans are the matches of three patterns; they always stay. Further candidates come from patterns
of well-known token forms. Over the whole corpus the values of all candidates are hashed, and for each
hash the distinct repositories and owners that hold it are counted. A value that many repositories and
owners have is a copied example; one that a single owner has is likely live, and what lies between is
unclear. Of the further candidates only examples are left out; ``verdicts`` names each one's verdict.

All of it is DataFrame operations. Offsets come from splitting a text at a pattern: a match begins
after the pieces and matches before it, whose lengths are summed up by a window over a text's matches. Ownership is counted after (hash, owner) pairs are made
distinct, so a value with a third of all occurrences sends one row from each task, and the counts are
joined to the occurrences from written tables, which lets Spark split a hot hash.

Defined results: a null or empty text has no spans; null repositories and owners are one unnamed
repository and owner; repeated rows are answered each and count as one owner; an empty table gives no
rows; offsets are code points. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut


@dataclass(frozen=True)
class Kind:
    """``value`` is the group that is the secret; ``least`` the characters it must have; ``hint`` spares texts without it."""

    name: str
    pattern: str
    value: int = 0
    least: int = 1
    hint: str | None = None


#: The base patterns.
BASE = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA"),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Published forms of tokens and keys.
ADDED = (
    Kind("hub", r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Kind("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
    Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,}-----END [A-Z ]*PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Kind("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]{20,}", hint="earer "),
    Kind("url", r"[a-z][a-z0-9+]{1,20}://[A-Za-z0-9._%-]{1,64}:[^\s:@/]{3,64}@[A-Za-z0-9.-]+", hint="://"),
)
KINDS = BASE + ADDED
#: A value is live-looking if at most so many owners have it, and an example from so many owners and repositories on.
LIVE_OWNERS, EXAMPLE_OWNERS = 1, 3
SPAN = "struct<start: int, rank: int, end: int, value: string>"


MATCHES = "array<struct<piece: int, whole: int, value: string>>"


def matches(text: Column, kind: Kind) -> Column:
    """Of each match of a kind, in order: the characters since the match before, its own, and its value."""
    pattern = F.lit(kind.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(kind.value)) if kind.value else whole
    pieces = F.transform(F.split(text, kind.pattern), F.length)
    rows = F.arrays_zip(pieces.alias("piece"), F.transform(whole, F.length).alias("whole"), value.alias("value"))
    present = text.contains(kind.hint) if kind.hint else text.rlike(kind.pattern)
    return F.when(present, rows).otherwise(F.array().cast(MATCHES))


def placed(found: DataFrame) -> DataFrame:
    """(row, repository, owner, start, rank, end, value) of the matches that are long enough, by running sums.

    A running sum over the matches of one text and kind takes time in proportion to their number.
    """
    each = found.select("row", "repository", "owner", F.posexplode("matches").alias("rank", "own")).select("row", "repository", "owner", "rank", F.posexplode("own").alias("k", "m"))
    each = each.where("m.whole is not null").select("row", "repository", "owner", "rank", "k", "m.*")
    so_far = Window.partitionBy("row", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("piece") + F.col("whole")).over(so_far).cast("int"))
    least = F.element_at(F.array(*[F.lit(k.least) for k in KINDS]), F.col("rank") + 1)
    return each.where(F.length("value") >= least).select("row", "repository", "owner", (F.col("end") - F.col("whole")).alias("start"), "rank", "end", "value")


def listed(spans: Column) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of (hash, repository, owner) rows: distinct ones, over all."""
    each = candidates.select("hash", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("repository").alias("name")), F.struct(F.lit(1).alias("side"), F.col("owner").alias("name")))).alias("of"))
    distinct = each.select("hash", "of.side", "of.name").distinct()
    count = lambda side: F.sum((F.col("side") == side).cast("long"))
    return distinct.groupBy("hash").agg(count(0).alias("repositories"), count(1).alias("owners"))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_cols: tuple[str, ...] = ("source", "lang"), owner_cols: tuple[str, ...] = ("source",)
) -> tuple[DataFrame, DataFrame]:
    """Rows with their spans, and the candidates with their owners.

    The first table has (row, id, base, found, verdicts, n_live, n_example): ``base`` and all spans sorted
    by start, then kind, and kind:start:end:verdict of every candidate, also of those left out; the second (row, start, rank, end, value, hash, repositories, owners, verdict), verdict being live,
    example or unclear.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = lambda cols: F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), name(repository_cols).alias("repository"), name(owner_cols).alias("owner"))
    # Written with a number for each row, which later steps can rely on.
    own = own.select("id", "repository", "owner", F.array(*[matches(F.col("text"), k) for k in KINDS]).alias("matches"))
    own = cut(own.withColumn("row", F.monotonically_increasing_id()), "matches")

    each = cut(placed(own).withColumn("hash", F.unhex(F.sha2("value", 256))), "candidates")
    told = each.join(cut(ownership(each), "ownership"), "hash")
    verdict = F.when(F.col("owners") <= LIVE_OWNERS, "live").when(F.least("owners", "repositories") >= EXAMPLE_OWNERS, "example").otherwise("unclear")
    told = told.withColumn("verdict", verdict).drop("repository", "owner")

    span = F.struct("start", "rank", "end", "value", "verdict")
    judged = told.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("judged"))
    names = F.array(*[F.lit(k.name) for k in KINDS])
    said = F.concat_ws(",", F.transform("judged", lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"], s["verdict"])))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["value"].alias("value")))
    count = lambda v: F.size(F.filter("judged", lambda s: s["verdict"] == v)).cast("long")
    none = F.array().cast(f"array<{SPAN}>")
    out = own.select("row", "id").join(judged, "row", "left").select(
        "row",
        "id",
        F.coalesce(bare(F.filter("judged", lambda s: s["rank"] < len(BASE))), none).alias("base"),
        F.coalesce(bare(F.filter("judged", lambda s: (s["rank"] < len(BASE)) | (s["verdict"] != "example"))), none).alias("found"),
        said.alias("verdicts"),
        F.coalesce(count("live"), F.lit(0).cast("long")).alias("n_live"),
        F.coalesce(count("example"), F.lit(0).cast("long")).alias("n_example"),
    )
    return out, told
