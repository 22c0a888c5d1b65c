"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are what the patterns of KINDS match in a text. Their values are hashed and counted over the corpus: by
distinct repositories and by distinct owners. A value that MIN_OWNERS owners and MIN_REPOSITORIES repositories have is a widely copied
example; any other is owner-specific and looks live. Spans of the base kinds (assign, access, hex) are always
reported; those of the further kinds where they look live.

Counts are made from distinct (hash, owner, repository) rows, aggregated before they are shuffled. Candidates meet
the examples by hash and a salt, as one example may hold a third of all candidates; then they go back by document.
Texts are not shuffled by the scan; redaction shuffles those that hold a candidate.

Nulls: a null text is empty; a null owner or repository is an owner of its own; a null id stays null. Repeated
documents give a row each, and count as one owner if they have one source. An empty table gives no rows. Text
positions are code points. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketpulse.llm.frames import checkpointed

MIN_OWNERS = 3
MIN_REPOSITORIES = 3
SALTS = 16
MASK = "[SECRET]"

#: kind, pattern, the group that is the value, least length of that group, whether it is a base kind, and texts of
#: which a match has one (a search for them is cheap, and most documents have none)
KINDS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
        True,
        (":", "="),
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, True, ("AKIA",)),
    ("hex", r"[0-9a-f]{16,}", 0, 16, True, ()),
    ("bearer", r"(?:[Bb]earer|BEARER)\x20+([A-Za-z0-9+/_.=~-]{20,})", 1, 20, False, ("earer ", "EARER ")),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, False, ("eyJ",)),
    (
        "prefixed",
        r"(?:gh[opsru]_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{20,}",
        0,
        24,
        False,
        ("gh", "glpat-", "xox", "sk_live_", "AIza"),
    ),
    # The whole run before "://", so that every run is looked at once; any user, or none, and any password.
    (
        "url",
        r"(?<![a-z0-9+])[a-z0-9+]{2,}+://[^\x20\x09-\x0D/:@]*+:([^\x20\x09-\x0D/:@]{6,}+)@",
        1,
        6,
        False,
        ("://",),
    ),
    # Up to its end mark, with header lines if it has any; or what may be a key that lacks the mark.
    (
        "key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
        r"(?:[A-Za-z0-9+/=:,.\x20\x09-\x0D-]{64,}?-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\x20\x09-\x0D]{64,})",
        0,
        90,
        False,
        ("PRIVATE KEY-----",),
    ),
)


def _matches(text: Column, pattern: str, needles: Sequence[str]) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not needles:
        return found
    has = reduce(or_, (F.contains(text, F.lit(n)) for n in needles))
    return F.when(has, found).otherwise(F.array().cast("array<string>"))


def _starts(text: Column, pattern: str, matches: Column) -> Column:
    """Where each match begins: the texts between matches and the matches before it, added up."""
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    steps = F.zip_with(gaps, F.transform(matches, F.char_length), lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + F.coalesce(x["size"], F.lit(0))).alias("at"), F.concat(acc["out"], F.array(start)).alias("out"))

    return F.aggregate(steps, first, step, lambda acc: acc["out"])


def _spans(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """The matches of one kind whose value is long enough."""
    match = F.col(f"_match_{kind}")
    value = F.regexp_extract_all(F.col("_text"), F.lit(pattern), F.lit(group)) if group else match

    def span(x: Column) -> Column:
        return F.struct(
            x["start"].alias("start"),
            F.lit(rank).alias("rank"),
            (x["start"] + F.char_length(x["match"])).alias("end"),
            F.lit(kind).alias("kind"),
            F.sha2(x["value"], 256).alias("hash"),
            F.char_length(x["value"]).alias("size"),
        )

    zipped = F.arrays_zip(match.alias("match"), F.col(f"_start_{kind}").alias("start"), value.alias("value"))
    rows = F.filter(F.transform(zipped, span), lambda x: x["size"] >= least)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,hash:string,size:int>>")
    return F.when(F.size(match) > 0, rows).otherwise(none)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The frame with `found`: (start, rank, end, kind, hash) of each candidate, in order of start and then kind."""
    text = F.col("_text")
    frame = docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    frame = frame.withColumns({f"_match_{kind}": _matches(text, p, needles) for kind, p, *_, needles in KINDS})
    frame = frame.withColumns(
        {
            f"_start_{kind}": F.when(F.size(f"_match_{kind}") > 0, _starts(text, p, F.col(f"_match_{kind}")))
            for kind, p, *_ in KINDS
        }
    )
    lists = [_spans(rank, *kind[:4]) for rank, kind in enumerate(KINDS)]
    return frame.select(*(F.col(c) for c in docs.columns), F.array_sort(F.concat(*lists)).alias("found"))


def examples(found: DataFrame) -> DataFrame:
    """Hashes of widely copied values, from (owner, repository, found) rows."""
    one = found.select("owner", "repository", F.explode("found.hash").alias("hash"))
    one = one.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    owners = one.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    counted = owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    return counted.where((F.col("owners") >= MIN_OWNERS) & (F.col("repositories") >= MIN_REPOSITORIES)).select("hash")


def _known(found: DataFrame) -> DataFrame:
    """Per document key: the examples among its candidates."""
    salted = found.select("key", F.explode(F.array_distinct("found.hash")).alias("hash"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    spread = examples(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["hash", "salt"]).groupBy("key").agg(F.collect_set("hash").alias("examples"))


def _key(doc_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit(""))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_cols: Sequence[str] = ("source", "lang"),
) -> DataFrame:
    """Per document: doc_id, key, found (candidates), examples (their hashes that are widely copied; null if none)."""
    parts = [F.coalesce(docs[c].cast("string"), F.lit("")) for c in repository_cols]
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        _key(docs[id_col]).alias("key"),
        docs[owner_col].cast("string").alias("owner"),
        F.concat_ws("\n", *parts).alias("repository"),
        docs[text_col].alias("text"),
    )
    found = checkpointed(candidates(rows).drop("text"))  # narrow; the texts are scanned once
    return found.select("doc_id", "key", "found").join(_known(found), "key", "left")


def _is_example(x: Column, known: Column) -> Column:
    return F.coalesce(F.array_contains(known, x["hash"]), F.lit(False))


def _listed(spans: Column) -> Column:
    def one(x: Column) -> Column:
        return F.concat_ws(":", x["kind"], x["start"], x["end"])

    return F.array_join(F.transform(spans, one), ",")


def report(docs: DataFrame) -> DataFrame:
    """Digests of each document's spans."""
    found, known = F.col("found"), F.col("examples")
    base_kinds = sum(base for *_, base, _ in KINDS)
    base = F.filter(found, lambda x: x["rank"] < base_kinds)
    live = F.filter(found, lambda x: ~_is_example(x, known))
    shown = F.filter(found, lambda x: (x["rank"] < base_kinds) | ~_is_example(x, known))

    def count(kind: str) -> Column:
        return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scan(docs).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(shown).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        (F.size(found) - F.size(live)).cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The documents with MASK in place of each span that looks live; widely copied examples stay.

    Columns stay as they are, but for the text and its length. Only texts that hold a candidate are shuffled.
    """
    known = scan(docs, id_col, text_col).where(F.col("examples").isNotNull())
    # kept, so that the long expressions below are planned once and not again after each shuffle above
    known = checkpointed(known.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("examples"))).alias("examples")))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), _key(docs[id_col]).alias("key"), docs[text_col].alias("text")
    )
    marked = candidates(rows)
    clean = marked.where(F.size("found") == 0).select("row")
    held = marked.where(F.size("found") > 0).join(known, "key", "left")
    spans = F.filter("found", lambda x: ~_is_example(x, F.col("examples")))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.col("text")

    def step(acc: Column, x: Column) -> Column:
        new = F.concat(acc["out"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(MASK))
        out = F.when(x["start"] >= acc["at"], new).otherwise(acc["out"])  # else it overlaps the span before
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate(
        spans, first, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.char_length(text)))
    )
    held = held.select("row", masked.alias("masked"))
    row = F.col("row").withField(text_col, F.col("masked"))
    if n_chars_col in docs.columns:
        row = row.withField(n_chars_col, F.char_length("masked").cast(docs.schema[n_chars_col].dataType))
    return clean.union(held.select(row.alias("row"))).select("row.*")
