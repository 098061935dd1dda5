"""Secret scans with multipart credential linking, with DataFrame functions only.

Three base kinds are found by pattern alone. Three weak kinds are reported only in company: a credential is a
set of parts, an identifier, a secret and an endpoint, and a weak candidate counts when the parts that
complete it begin or end within SCOPE code points of it in the same text:

- ident (a user or client name that is assigned): with a secret (assign, hex or key40);
- key40 (a bare run of exactly 40 base-64 characters, '=' only as padding at its end, so that an assignment's
  '=' isn't part of the value): with an identifier (access or ident);
- endpoint (the host part of a URL): with both an identifier and a secret.

The company is found by an interval join on (row, stretch of SCOPE code points); it is a semi join, so a
candidate counts once, whatever the number of its partners.

Positions come from native functions: a text is split at the matches of a pattern, and the lengths of pieces
and matches, summed up, give where each match begins. Texts are read once; all later steps see only matches.

Cases: a null or empty text has no spans. Repeated rows are rows of their own. Very long texts need no more
than their matches in memory; a text's matches of one kind are sorted together. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import stash

SCOPE = 256

#: The patterns of the base kinds and what a match must have.
BASE = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: The least lengths: of the assigned value, and of the whole match.
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: A pattern that holds in every text with a match that counts; it spares the others the search.
HINT = {"hex": r"[0-9a-f]{16}", "key40": r"[A-Za-z0-9+/=]{40}"}
WEAK = {
    "ident": r"""(?i)(?:username|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]+""",
    "key40": r"[A-Za-z0-9+/]+={0,2}",
    "endpoint": r"https?://[A-Za-z0-9.-]+",
}
KINDS = [*BASE, *WEAK]
#: What is searched instead, where the pattern can ask for the length: a run is taken whole or not at all, so the
#: matches that count are the same, and those that don't are never made into rows.
SEARCHED = {
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "key40": r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])|[A-Za-z0-9+/]{39}=(?!=)|[A-Za-z0-9+/]{38}==)",
}


def _found(text: Column, pattern: str, hint: str) -> Column:
    """Lengths of the pieces between matches, and the matches; null where there is none."""
    pieces = F.transform(F.split(text, pattern, -1), F.length)
    return F.when(text.rlike(hint), F.struct(pieces.alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches")))


def _counts(kind: Column, match: Column) -> Column:
    """Whether a match is one, by its kind."""
    value = F.regexp_extract(match, BASE["assign"], 1)
    return (
        F.when(kind == "assign", F.length(value) >= LEAST["assign"])
        .when(kind == "access", F.length(match) >= LEAST["access"])
        .when(kind == "hex", F.length(match) >= LEAST["hex"])
        .when(kind == "key40", (F.length(match) == 40) & match.rlike("[0-9]") & match.rlike("[a-z]") & match.rlike("[A-Z]"))
        .otherwise(F.lit(True))
    )


def _near(targets: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """Those targets that have a part within scope."""
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / scope), F.floor(b / scope)))
    t = targets.withColumn("stretch", stretch(F.col("start") - scope, F.col("stop") + scope))
    p = parts.select(F.col("row").alias("p_row"), F.col("start").alias("p_start"), F.col("stop").alias("p_stop"), stretch(F.col("start"), F.col("stop")).alias("p_stretch"))
    on = [t["row"] == p["p_row"], t["stretch"] == p["p_stretch"], p["p_start"] <= t["stop"] + scope, p["p_stop"] >= t["start"] - scope]
    return t.join(p, on, "left_semi").drop("stretch").distinct()


def scan(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """Spans for every row of docs (doc_id, text).

    Returns row (of the input), doc_id and spans, an array of (start, rank, stop, kind) in order, where rank is
    the kind's place in KINDS and positions count code points, the end exclusive.
    """
    text = F.col("text")
    company = text.rlike(BASE["access"]) | text.rlike(WEAK["ident"])
    one = lambda k, p: _found(text, SEARCHED.get(k, p), HINT.get(k, p))
    searched = [one(k, p).alias(k) for k, p in BASE.items()] + [F.when(company, one(k, p)).alias(k) for k, p in WEAK.items()]
    rows = stash(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *searched), "secrets")
    # a row for each match: its place follows from the lengths before it
    pairs = lambda k: F.transform(F.col(f"{k}.matches"), lambda m, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.element_at(F.col(f"{k}.pieces"), i + 1).alias("gap"), m.alias("match")))
    matches = rows.select("row", F.explode(F.concat(*[F.coalesce(pairs(k), F.array().cast("array<struct<kind:string,i:int,gap:int,match:string>>")) for k in KINDS])).alias("m")).select("row", "m.*")
    along = Window.partitionBy("row", "kind").orderBy("i")
    matches = matches.withColumn("stop", F.sum(F.col("gap") + F.length("match")).over(along))
    matches = matches.filter(_counts(F.col("kind"), F.col("match"))).select("row", "kind", (F.col("stop") - F.length("match")).alias("start"), "stop")
    matches = stash(matches, "secret-matches")
    of = lambda *kinds: matches.filter(F.col("kind").isin(*kinds))
    identifiers, secrets = of("access", "ident"), of("assign", "hex", "key40")
    spans = of(*BASE).unionByName(_near(of("ident"), secrets, scope)).unionByName(_near(of("key40"), identifiers, scope))
    spans = spans.unionByName(_near(_near(of("endpoint"), identifiers, scope), secrets, scope))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "stop", "kind"))).alias("spans"))
    nothing = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    return rows.select("row", "doc_id").join(spans, "row", "left").withColumn("spans", F.coalesce("spans", nothing))


def written(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of the spans of some kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
