"""Secret scans.

Method: a trigram inverted index. A Boolean query over the trigrams that every match must hold is derived from each
rule's pattern (``trigrams``). Postings (trigram, document) are kept for the trigrams that queries ask for; they are
intersected and united as the queries say, and the documents that are left are verified by the pattern. A rule
without mandatory trigrams scans all documents.

Only DataFrame functions; offsets are code points.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldscope.llm import blocks, shingles, trigrams
from fieldscope.session import pin


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a Java regular expression; a match counts if ``group`` has ``least`` characters.

    ``base`` rules enter the base digest in this order.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: Patterns and minimum lengths of the base kinds, then common token formats.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),  # the runs of at least 24
    Rule("private_key", r"-----BEGIN (?:[A-Z ]* )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """(trigram, row_key): which of the trigrams each text holds, letters in either case; a row each."""
    held = F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams], F.lit(None).cast("string"))
    return rows.select("row_key", F.lower("text").alias("low")).select("row_key", F.explode(F.array_compact(held)).alias("trigram"))


def _holds(query, held: str) -> Column:
    """Whether an array of trigrams satisfies a query."""
    if isinstance(query, str):
        return F.array_contains(held, query)
    parts = [_holds(q, held) for q in sorted(query[1], key=str)]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_key, kinds): the rules whose query a row's postings satisfy. A row has no more postings than queries have trigrams."""
    held = index.groupBy("row_key").agg(F.collect_set("trigram").alias("held"))
    kinds = F.array_compact(F.array(*[F.when(_holds(trigrams.trigram_query(r.pattern), "held"), r.kind) for r in rules], F.lit(None).cast("string")))
    return held.select("row_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _matches(rule: Rule) -> Column:
    """The matches of a rule in ``text`` with the text between: an array of (kind, gap, length, counted)."""
    gaps = F.split("text", rule.pattern, -1)
    whole = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    value = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    return F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), value.alias("value")),
        lambda x: F.struct(
            F.lit(rule.kind).alias("kind"),
            F.char_length(x["gap"]).alias("gap"),
            F.char_length(x["hit"]).alias("length"),
            (F.char_length(x["value"]) >= rule.least).alias("counted"),
        ),
    )


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per input row: doc_id, row_key, spans: an array of (start, rank, kind, end) in order of start, then of the rules.

    Matches are the leftmost ones that don't overlap, per rule over the whole text; those whose group is too short
    are dropped but still take up their text. row_key names the row by id and text: rows that repeat get the same answer. Null
    or empty text has no spans; null ids are ids like others. Other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        blocks.row_key(doc_id, text).alias("row_key"),
        F.col(text).cast("string").alias("text"),
    )
    queries = {r: trigrams.trigram_query(r.pattern) for r in rules}
    indexed = tuple(r for r in rules if queries[r] is not True)
    grams = sorted(set().union(*map(trigrams.grams_of, queries.values())))
    n_rows = docs.count()
    index = pin(postings(rows, grams).repartition("trigram", "row_key").sortWithinPartitions("trigram"), "trigram-index", n_rows)

    nothing = F.array().cast("array<struct<kind:string,gap:int,length:int,counted:boolean>>")
    full = [F.when(F.col("text").rlike(r.pattern), _matches(r)).otherwise(nothing) for r in rules if r not in indexed]
    scanned = rows.select("row_key", F.concat(*full, nothing).alias("found"))

    asked = candidates(index, indexed)
    joined = rows.join(shingles.sendable(asked, "secret-candidates", rows=n_rows), "row_key")
    verified = joined.select("row_key", F.concat(*[F.when(F.array_contains("kinds", r.kind), _matches(r)).otherwise(nothing) for r in indexed], nothing).alias("found"))

    hits = scanned.where(F.size("found") > 0).union(verified.where(F.size("found") > 0)).dropDuplicates(["row_key", "found"])
    flat = hits.select("row_key", F.posexplode("found").alias("n", "hit")).select("row_key", "n", "hit.*")
    # a match starts after all gaps and matches of its rule before it
    before = Window.partitionBy("row_key", "kind").orderBy("n")
    placed = flat.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(before)).where("counted")
    rank = F.element_at(F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))]), F.col("kind"))
    span = F.struct((F.col("end") - F.col("length")).alias("start"), rank.alias("rank"), "kind", "end")
    spans = placed.groupBy("row_key").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    empty = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("doc_id", "row_key").join(spans, "row_key", "left").withColumn("spans", F.coalesce("spans", empty))


def written(spans: str, kinds: list[str] | None = None) -> Column:
    """``kind:start:end`` of the spans, joined by commas."""
    chosen = F.col(spans) if kinds is None else F.filter(spans, lambda s: s["kind"].isin(kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "<secret>", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask``; overlapping spans share one. All rows and columns stay."""
    key, spans = blocks.spare("_row_key", docs.columns), blocks.spare("_spans", docs.columns)
    found = secret_spans(docs, rules, doc_id, text).where(F.size("spans") > 0)
    found = found.select(F.col("row_key").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
    rows = docs.withColumn(key, blocks.row_key(doc_id, text)).join(found, key, "left")
    begin = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    source = F.col(f"`{text}`")

    def step(done, span):
        gap = F.substr(source, (done["at"] + 1).cast("int"), (span["start"] - done["at"]).cast("int"))
        return F.when(span["end"] <= done["at"], done).otherwise(
            F.struct(F.concat(done["out"], F.when(span["start"] >= done["at"], F.concat(gap, F.lit(mask))).otherwise("")).alias("out"), F.greatest(span["end"], done["at"]).alias("at"))
        )

    rest = lambda done: F.concat(done["out"], F.substr(source, (done["at"] + 1).cast("int"), F.char_length(source)))
    clean = F.when(F.col(spans).isNull(), source).otherwise(F.aggregate(spans, begin, step, rest))
    return rows.withColumn(text, clean).select(*[F.col(f"`{c}`") for c in docs.columns])
