"""Secret scans over a trigram inverted index; DataFrame functions only.

Each rule's regular expression yields a Boolean query on trigrams: one of several alternatives,
each a set of trigrams that all must occur. The index holds (trigram, document) postings for the
trigrams that the rules mention; intersecting them by alternative gives each rule its candidate
documents, and only those are verified with the expression itself. Rules without mandatory
trigrams scan all documents.

Postings name a document by its id and the hash of its text, so rows with equal ids keep apart and
rows with null ids spread. A null text is empty and gives no spans. An empty table gives no rows.
Positions count code points. Columns other than the two named are ignored.
"""

from __future__ import annotations

import re._parser as sre
from dataclasses import dataclass
from re import _constants as op

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilcount.llm._shared import table, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: spans are the matches whose `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds in listed order, then those that this method adds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
ADDED = (
    # To the END line, however far, unless another key begins first; a key that is cut off before it, to its last
    # whole line. Single characters repeat, so Java's matcher loops over a body of any length and doesn't recurse.
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
        r"(?:(?:(?!-----BEGIN)[A-Za-z0-9+/=:,\s-])*?-----END [A-Z ]*PRIVATE KEY-----"
        r"|(?:\s[A-Za-z0-9+/=\s]*(?<=[A-Za-z0-9+/=]{40})(?![A-Za-z0-9+/=]))?)",
    ),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED

#: Exact strings that one part of an expression may stand for, before it is cut into trigrams.
MOST_STRINGS = 64

Query = frozenset[frozenset[str]]  # any of these sets, all of its trigrams
ANYTHING: Query = frozenset([frozenset()])


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def simplest(query: Query) -> Query:
    """Without alternatives that ask for more than another does."""
    return frozenset(a for a in query if not any(b < a for b in query))


def both(a: Query, b: Query) -> Query:
    return simplest(frozenset(x | y for x in a for y in b))


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that any match of the pattern must hold."""
    strings, query = _walk(sre.parse(pattern))
    return both(query, _cut(strings))


def _cut(strings: frozenset[str]) -> Query:
    return simplest(frozenset(trigrams(s) for s in strings)) if strings else ANYTHING


def _walk(items) -> tuple[frozenset[str], Query]:
    """The exact strings that the items' end stands for, and what came before as a query."""
    strings, query = frozenset([""]), ANYTHING
    for kind, arg in items:
        one: frozenset[str] | None = None
        extra = ANYTHING
        if kind is op.LITERAL:
            one = frozenset([chr(arg).lower()])
        elif kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            one = frozenset(chr(c).lower() for _, c in arg)
        elif kind is op.SUBPATTERN:
            one, extra = _walk(arg[-1])
        elif kind is op.BRANCH:
            each = [_walk(x) for x in arg[1]]
            if all(q == ANYTHING for _, q in each):
                one = frozenset().union(*(s for s, _ in each))
            else:
                extra = simplest(frozenset().union(*(both(q, _cut(s)) for s, q in each)))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, inner = arg
            found, within = _walk(inner)
            if within == ANYTHING and most == 1:
                one = found | {""} if least == 0 else found
            elif least and within != ANYTHING:
                extra = both(within, _cut(found))
        joined = frozenset(a + b for a in strings for b in one) if one is not None else None
        query = both(query, extra)
        if joined is None or len(joined) > MOST_STRINGS or extra != ANYTHING:
            query, strings = both(query, _cut(strings)), one if one is not None else frozenset([""])
            strings = strings if len(strings) <= MOST_STRINGS else frozenset([""])
        else:
            strings = joined
    return strings, query


def postings(docs: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, doc_id, text_key): the inverted index, for these trigrams of the lower-case texts."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return docs.select("doc_id", "text_key", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, text_key and the numbers of the rules whose trigram queries its postings satisfy."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANYTHING}
    grams = sorted({g for q in queries.values() for alt in q for g in alt})
    number = {g: i for i, g in enumerate(grams)}
    asked = [
        (i, k, number[g], len(alt)) for i, q in queries.items() for k, alt in enumerate(sorted(q, key=sorted)) for g in alt
    ]
    spark = docs.sparkSession
    query = F.broadcast(  # as large as the rules
        spark.createDataFrame(asked, "rule int, alternative int, gram int, needed int")
    )
    met = (
        postings(docs, grams)
        .join(query, "gram")
        .groupBy("doc_id", "text_key", "rule", "alternative", "needed")
        .agg(F.count_distinct("gram").alias("held"))
        .where("held = needed")
    )
    # no more rules than there are
    return met.groupBy("doc_id", "text_key").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The rule's matches as (start, order, end, kind), end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    before = F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0)))
    steps = F.arrays_zip(
        F.transform(before, F.length).alias("gap"),
        F.transform(found, F.length).alias("long"),
        F.transform(tested, F.length).alias("tested"),
    )

    def span(start: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))

    def step(done: Column, s: Column) -> Column:
        start = done["at"] + s["gap"]
        end = start + s["long"]
        more = F.concat(done["out"], F.array(span(start, end)))
        return F.struct(end.alias("at"), F.when(s["tested"] >= rule.least, more).otherwise(done["out"]).alias("out"))

    return folded(steps, SPANS, step)["out"]


#: Items of a fold in a row. Each step copies what its array holds, so a text with k spans costs k * FOLD + (k / FOLD) ** 2.
FOLD = 1024
SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(items: Column, kind: str, step) -> Column:
    """(at, out) after step(state, item) for each item, from 0 and an empty array of this kind: run by run."""

    def start(at: Column) -> Column:
        return F.struct(at.alias("at"), F.array().cast(kind).alias("out"))

    def run(done: Column, items: Column) -> Column:
        whole = lambda own: F.struct(own["at"].alias("at"), F.concat(done["out"], F.array(own["out"])).alias("out"))
        return _let(F.aggregate(items, start(done["at"]), step), whole)

    def runs(found: Column) -> Column:
        last = F.floor((F.greatest(F.size(found), F.lit(1)) - 1) / FOLD).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(found, i * FOLD + 1, FOLD))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(_let(items, runs), first, run, lambda d: F.struct(d["at"].alias("at"), F.flatten(d["out"]).alias("out")))


def no_spans() -> Column:
    return F.array().cast(SPANS)


def all_spans(text: Column, held: Column, rules=RULES) -> Column:
    """Spans of all rules, by start, then by the rules' order. held: the rules that the index leaves."""
    parts = []
    for i, rule in enumerate(rules):
        full = trigram_query(rule.pattern) == ANYTHING
        wanted = F.rlike(text, F.lit(rule.pattern)) if full else F.array_contains(held, F.lit(i))
        parts.append(F.when(wanted, spans_of(text, rule, i)).otherwise(no_spans()))
    return F.array_sort(F.concat(*parts))


def with_candidates(rows: DataFrame, doc_id: Column, text: Column, rules) -> DataFrame:
    """rows with _held: the rules that the index leaves for each."""
    keyed = rows.withColumn("_id", doc_id).withColumn("_key", F.xxhash64(text))
    own = keyed.select(F.col("_id").alias("doc_id"), F.col("_key").alias("text_key"), text.alias("text"))
    named = candidates(own, rules).select(F.col("doc_id").alias("_own"), "text_key", F.col("rules").alias("_held"))
    met = F.col("_id").eqNullSafe(F.col("_own")) & (F.col("_key") == F.col("text_key"))
    return keyed.join(named, met, "left").drop("_id", "_key", "_own", "text_key")


def scan(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and found: its spans by start, then by the rules' order."""
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    joined = with_candidates(own, F.col("doc_id"), F.col("text"), rules)
    return joined.select("doc_id", "text", all_spans(F.col("text"), F.col("_held"), rules).alias("found"))


def masked(text: Column, found: Column, mask: str) -> Column:
    """The text with its spans, those that overlap as one, replaced by the mask. found: ordered by start."""

    def step(done: Column, s: Column) -> Column:
        piece = F.concat(text.substr(done["at"] + 1, s["start"] - done["at"]), F.lit(mask))
        parts = F.when(s["start"] >= done["at"], F.concat(done["out"], F.array(piece))).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"), parts.alias("out"))

    rest = lambda done: text.substr(done["at"] + 1, F.length(text))
    return _let(folded(found, "array<string>", step), lambda done: F.concat(F.array_join(done["out"], ""), rest(done)))


def redact(
    docs: DataFrame, rules=RULES, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with the spans that scan() finds replaced by the mask; all columns and rows stay.

    The original text is cut once, so no rule sees what another has changed. n_chars, where there is
    such a column, follows the text.
    """
    whole = docs.select(F.struct(*docs.columns).alias("_row"))
    text = F.col(f"_row.{text_col}")
    joined = with_candidates(whole, F.col(f"_row.{id_col}"), text_of(text), rules)
    found = joined.withColumn("_found", all_spans(text_of(text), F.col("_held"), rules))
    clean = F.when(F.size("_found") > 0, masked(text, F.col("_found"), mask)).otherwise(text)
    out = [F.col("_text" if c == text_col else f"_row.{c}").alias(c) for c in docs.columns]
    cleaned = found.withColumn("_text", clean).select(*out)
    if "n_chars" not in docs.columns:
        return cleaned
    n_chars = F.when(F.col(text_col).isNotNull(), F.length(text_col)).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", n_chars)


def op5_secrets(spark, sf_dir):
    found = scan(table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(k: int) -> Column:
        """A filter's second parameter, even one with a default, would be the index."""
        return F.size(F.filter("found", lambda s: s["order"] == k)).cast("long")

    base = F.filter("found", lambda s: s["order"] < len(BASE))
    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select(
        "doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )
