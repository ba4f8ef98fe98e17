"""Secret scans with corpus-wide ownership frequency.

Three fixed patterns give base candidates: assigned values, access keys, hexadecimal runs. Long runs of letters and digits outside them are bare
candidates. A pattern alone can't tell a live credential from one that a manual prints and everybody copies, so candidates are counted over the
whole corpus: in how many distinct repositories and of how many distinct owners does a value stand? Values of many owners are examples; values of
few are owner-specific. Base spans always stay, each with its verdict. A bare span is added if its value is owner-specific and it is known to be a
secret (somewhere it is assigned, or an access key) or looks random.

The text is read once and not shuffled; what goes on is a digest a candidate. Counting combines in the tasks. Verdicts return to the documents by
a join on digest and salt, so that a value which stands in a third of all rows goes to many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal, ship, slices

# The base patterns. Letters of the first stand for both cases, in ASCII only.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "bare"]
#: Bare candidates: runs of these characters, this long, with a letter and a digit; random if they have so many distinct characters.
BARE, BARE_LENGTH, RANDOM_CHARACTERS = r"[A-Za-z0-9+/_=-]", 20, 10
#: A value of more owners than this, or in more repositories, is an example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 100
SALTS = 16

_ASSIGN, _ACCESS = re.compile(ASSIGN, re.IGNORECASE | re.ASCII), re.compile(ACCESS)
# a run of 24 or more is matched whole wherever a run of any length would be
_HEX, _BARE = re.compile(r"[0-9a-f]{24,}"), re.compile(rf"(?<!{BARE}){BARE}{{{BARE_LENGTH},}}")
FOUND = "array<struct<start:int,kind:int,end:int,digest:binary,random:boolean>>"


def found_in(text: str) -> list[tuple[int, int, int, str, bool]]:
    """(start, number of the kind, end, value, looks random) of all candidates, by start and kind. Bare ones overlap no other."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m[2], False) for m in _ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0], False) for m in _ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
    out += [(m.start(), 2, m.end(), m[0], False) for m in _HEX.finditer(text)]
    base, i, last = sorted(out), 0, 0
    for m in _BARE.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            last, i = max(last, base[i][2]), i + 1
        value = m[0]
        if last <= m.start() and re.search("[0-9]", value) and re.search("[A-Za-z]", value):
            out.append((m.start(), 3, m.end(), value, len(set(value)) >= RANDOM_CHARACTERS))
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("digest", pa.binary()), ("random", pa.bool_())]))
    for batch in batches:
        for part in slices(batch, "body"):
            rows = [[(a, k, b, hashlib.sha256(v.encode()).digest(), r) for a, k, b, v, r in found_in(t)] for t in part.column("body").to_pylist()]
            fields = [[dict(zip(("start", "kind", "end", "digest", "random"), x, strict=True)) for x in row] for row in rows]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("row", "repo", "owner")], pa.array(fields, kind)], ["row", "repo", "owner", "found"])


def scan_secrets(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """row (all columns of docs but the text) and spans, an array of (start, kind, end, digest, owners, repositories, example) by start, then kind
    (assign, access, hex, owned); a row for each row of docs.

    Positions are code points, the end exclusive; digest is the SHA-256 of the value: of an assignment what is assigned, else the span. Base spans
    (assign, access, hex) are all there; owned spans are the bare candidates that ownership adds. Null texts count as empty and have no spans; a null
    repository or owner counts as one of its own; repeated rows have equal spans and count as one repository. An empty table gives an empty result.
    Names of other columns never clash: they stay inside `row`.
    """
    ship(docs.sparkSession)
    work = Scratch(docs.sparkSession, "secrets")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(None).cast("string").alias("none")]
    rows = docs.select(F.struct(*others).alias("row"), name(repo_col).alias("repo"), name(owner_col).alias("owner"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, repo string, owner string, found {FOUND}"
    seen = work.table(rows.mapInArrow(frugal(_scan), schema).withColumn("number", F.monotonically_increasing_id()), "seen")
    each = seen.filter(F.size("found") > 0).select("number", "repo", "owner", F.explode("found").alias("x")).select("number", "repo", "owner", "x.*")
    verdicts = ownership(each, most_owners, most_repositories)
    salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    judged = each.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(SALTS)).cast("int")).join(salted, ["digest", "salt"])
    bare = F.col("kind") == KINDS.index("bare")
    judged = judged.filter(~bare | (~F.col("example") & (F.col("known") | F.col("random"))))
    span = F.struct("start", "kind", "end", "digest", "owners", "repositories", "example")
    spans = judged.groupBy("number").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    named = F.transform("spans", lambda s: s.withField("kind", F.get(F.array(*[F.lit(k) for k in KINDS[:-1]], F.lit("owned")), s["kind"])))
    return seen.join(spans, "number", "left").select("row", F.coalesce(named, F.array().cast("array<struct<start:int,kind:string,end:int,digest:binary,owners:bigint,repositories:bigint,example:boolean>>")).alias("spans"))


def ownership(candidates: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """digest, owners, repositories, example, known of candidates (digest, kind, repo, owner): distinct owners and repositories of each value in the
    whole corpus. known: it is assigned or an access key somewhere. Distinct pairs first, so no value is one task's own."""
    known = F.col("kind").isin(KINDS.index("assign"), KINDS.index("access"))
    parts = [candidates.select("digest", F.lit(c == "owner").alias("is_owner"), F.col(c).alias("who"), known.alias("known")) for c in ("owner", "repo")]
    pairs = parts[0].unionByName(parts[1]).groupBy("digest", "is_owner", "who").agg(F.max("known").alias("known"))
    out = pairs.groupBy("digest").agg(F.count_if("is_owner").alias("owners"), F.count_if(~F.col("is_owner")).alias("repositories"), F.max("known").alias("known"))
    return out.withColumn("example", (F.col("owners") > most_owners) | (F.col("repositories") > most_repositories))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
