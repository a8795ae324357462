"""Secrets in texts, told apart by who else holds them, in DataFrame operations only.

Candidates are found by patterns. Their hashes are counted over the whole corpus by distinct owners and repositories:
a value that many owners hold is a widely copied example; one that belongs to few and looks random is a live-looking
credential. Such values are added as spans of their own wherever they stand, also without a keyword before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermaline.staging import stage

# The kinds of spans in their order, pattern, group of the value, least length of the value.
BASE_KINDS = (
    (
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
OWNED = "owned"
OWNED_PATTERN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
#: From so many distinct owners on, a value is a widely copied example.
EXAMPLE_OWNERS = 3
#: As widely copied inside few owners: from so many repositories on a value is an example, too.
EXAMPLE_REPOSITORIES = 8
#: A live-looking value has at least so many distinct characters, a letter and a digit.
LIVE_CHARACTERS = 8


def _found(rows: DataFrame, kind: int, name: str, pattern: str, group: int, least: int) -> DataFrame:
    """The matches of one kind: key, kind, start, stop (code points), value.

    The pieces between the matches give their places, as running sums over one text's matches.
    """
    expression = F.lit(pattern)
    pieces = F.arrays_zip(
        F.split("text", pattern, -1).alias("gap"),
        F.regexp_extract_all("text", expression, F.lit(0)).alias("match"),
        F.regexp_extract_all("text", expression, F.lit(group)).alias("value"),
    )
    matches = (
        rows.where(F.rlike("text", expression))
        .select("doc_id", "digest", "owner", "repository", F.posexplode(pieces).alias("n", "piece"))
        .where("piece.match is not null")
        .select(
            "doc_id",
            "digest",
            "owner",
            "repository",
            "n",
            F.length("piece.gap").alias("gap"),
            F.length("piece.match").alias("size"),
            F.col("piece.value").alias("value"),
        )
    )
    so_far = (
        Window.partitionBy("doc_id", "digest", "owner", "repository")
        .orderBy("n")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        matches.distinct()
        .withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far))
        .where(F.length("value") >= least)
        .select(
            "doc_id",
            "digest",
            "owner",
            "repository",
            F.lit(kind).alias("kind"),
            F.lit(name).alias("name"),
            (F.col("stop") - F.col("size")).alias("start"),
            "stop",
            "value",
        )
    )


def _looks_random(value: Column) -> Column:
    return (
        (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
    )


def secret_spans(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """One row per candidate span of ``docs`` (doc_id, text, ...): doc_id, digest (of the text), kind, name, start, stop,
    n_owners, n_repositories, verdict ('example' or 'live'). Base spans come whole; 'owned' spans are live-looking
    values of few owners that overlap no base span of their text.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("digest"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        "text",
    ).where("text <> ''")
    kinds = [*BASE_KINDS, (OWNED, OWNED_PATTERN, 0, 20)]
    found = None
    for number, (name, pattern, group, least) in enumerate(kinds):
        here = _found(rows, number, name, pattern, group, least)
        if name == OWNED:
            here = here.where(_looks_random(F.col("value")))
        found = here if found is None else found.unionByName(here)
    found = stage(
        found.withColumn("value_key", F.unhex(F.md5(F.col("value").cast("binary"))))
        .withColumn("random", _looks_random(F.col("value")))
        .drop("value"),
        "candidates",
    )
    holders = found.select("value_key", "owner", "repository").distinct()
    ownership = holders.groupBy("value_key").agg(
        F.count_distinct("owner").alias("n_owners"), F.count_distinct("owner", "repository").alias("n_repositories")
    )
    judged = found.join(ownership, "value_key").withColumn(
        "verdict",
        F.when(
            (F.col("n_owners") < EXAMPLE_OWNERS) & (F.col("n_repositories") < EXAMPLE_REPOSITORIES) & F.col("random"), "live"
        ).otherwise("example"),
    )
    text = Window.partitionBy("doc_id", "digest", "owner", "repository").orderBy("start", "kind")
    is_base = F.col("name") != OWNED
    before = F.max(F.when(is_base, F.col("stop"))).over(text.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(text.rowsBetween(0, Window.unboundedFollowing))
    free = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (
        F.coalesce(after, F.col("stop")) >= F.col("stop")
    )
    return judged.withColumn("free", free).where(
        (F.col("name") != OWNED) | (F.col("free") & (F.col("verdict") == "live"))
    ).drop("free", "random")


def _listed(condition: Column) -> Column:
    entry = F.struct("start", "kind", F.concat_ws(":", "name", "start", "stop").alias("shown"))
    return F.array_join(F.sort_array(F.collect_list(F.when(condition, entry))).getField("shown"), ",")


def secrets(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """Documents (doc_id, text, ...) to doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples,
    n_owners, n_repositories (those of the most widely held value of the text).

    Spans are kind:start:stop in code points, by start, then kind. A null or empty text has none. Null owners and
    repositories are one holder of their own. Repeated rows get a row each; a value held by copies of one document
    under one owner still has one owner. A null doc_id is a key like any other. Other columns are ignored.
    """
    spans = secret_spans(docs, owner, repository)
    is_base = F.col("name") != OWNED
    by_text = spans.groupBy("doc_id", "digest", "owner", "repository").agg(
        *[F.count_if(F.col("name") == name).alias(f"n_{name}") for name, *_ in BASE_KINDS],
        F.sha2(_listed(is_base), 256).alias("base_sha256"),
        _listed(F.lit(True)).alias("spans"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_examples"),
        F.max("n_owners").alias("n_owners"),
        F.max("n_repositories").alias("n_repositories"),
    )
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("digest"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
    )
    matched = (
        keys.doc_id.eqNullSafe(by_text.doc_id)
        & (keys.digest == by_text.digest)
        & (keys.owner == by_text.owner)
        & (keys.repository == by_text.repository)
    )
    none = F.lit(0).cast("long")
    return keys.join(by_text, matched, "left").select(
        keys.doc_id,
        *[F.coalesce(f"n_{name}", none).alias(f"n_{name}") for name, *_ in BASE_KINDS],
        F.coalesce("base_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"),
        F.coalesce("n_examples", none).alias("n_examples"),
        F.coalesce("n_owners", none).alias("n_owners"),
        F.coalesce("n_repositories", none).alias("n_repositories"),
    )
