"""What relays say of themselves over a run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stated:
    """What a field's values look like, without blanks around, and which of the sound ones a run keeps: the first, the
    last, or all of them in order."""

    pattern: str
    keep: str = "last"
    #: Only what follows this word counts, where a value holds it.
    after: str | None = None


#: The fields, and the least that is asked of them. Printable characters are ASCII.
PRINTABLE = r"[\x20-\x7E\t\n\x0B\f\r]"
STATED = {
    "nickname": Stated(r"[A-Za-z0-9]{0,19}"),
    "orport": Stated(PRINTABLE + "{1,200}", "all"),
    "dirport": Stated(PRINTABLE + "{1,200}", "all"),
    "version": Stated(PRINTABLE + "+", after="version"),
    "address": Stated(r"[0-9.]{7,15}"),
    "fingerprint": Stated(r"[0-9A-Fa-f]{40}", "first"),
    "flags": Stated(r"(?s).*"),
    "geoip": Stated(r"(?s).*"),
}


def _cleaned(value: Column, rule: Stated) -> Column:
    if rule.after:
        # Regular expressions find the first occurrence; what is before it goes.
        value = F.regexp_replace(value, rf"(?s)^.*?\Q{rule.after}\E", "")
    return F.regexp_replace(value, r"^[\s\x0B]+|[\s\x0B]+$", "")


def stated_values(facts: DataFrame, rules: dict[str, Stated] | None = None) -> DataFrame:
    """facts (relay, seq, field, value) with the cleaned value, null where it is unsound, and whether it was given and bad.

    A field that no rule knows is unsound; a null value says nothing.
    """
    known = STATED if rules is None else rules
    clean, sound = F.lit(None).cast("string"), F.lit(False)
    for name, rule in known.items():
        own = _cleaned(F.col("value"), rule)
        clean = F.when(F.col("field") == name, own).otherwise(clean)
        sound = F.when(F.col("field") == name, own.rlike(f"\\A(?:{rule.pattern})\\z")).otherwise(sound)
    held = facts.withColumn("clean", F.when(sound, clean))
    return held.withColumn("bad", F.col("value").isNotNull() & F.col("clean").isNull())


def relay_metadata(facts: DataFrame, rules: dict[str, Stated] | None = None) -> DataFrame:
    """Relay, field, value that a run keeps, accepted, rejected and changes (sound values that differ from the one
    kept when they came: replaced by them, or, where the first is kept, refused). Fields never stated soundly have a null value.

    seq orders what a relay said; of equal ones the smaller value comes first.
    """
    known = STATED if rules is None else rules
    held = stated_values(facts, known)
    keep = F.lit("last")
    for name, rule in known.items():
        keep = F.when(F.col("field") == name, rule.keep).otherwise(keep)
    order = F.struct("seq", "clean")
    own = Window.partitionBy("relay", "field").orderBy(F.col("clean").isNull(), "seq", "clean")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    kept = F.when(keep == "first", F.first("clean", ignorenulls=True).over(before)).when(keep == "last", F.last("clean", ignorenulls=True).over(before))
    marked = held.withColumn("changed", F.col("clean").isNotNull() & F.coalesce(kept != F.col("clean"), F.lit(False)))
    # Sets are pre-aggregated; a relay's ports are few.
    found = marked.groupBy("relay", "field", keep.alias("keep")).agg(
        F.min_by("clean", F.when(F.col("clean").isNotNull(), order)).alias("first"),
        F.max_by("clean", F.when(F.col("clean").isNotNull(), order)).alias("last"),
        F.array_join(F.array_sort(F.collect_set(F.when(keep == "all", F.col("clean")))), ", ").alias("all"),
        F.count("clean").alias("accepted"),
        F.count_if("bad").alias("rejected"),
        F.count_if("changed").alias("changes"),
    )
    every = F.when(F.col("accepted") > 0, F.col("all"))
    value = F.when(F.col("keep") == "first", F.col("first")).when(F.col("keep") == "all", every).otherwise(F.col("last"))
    return found.select("relay", "field", value.alias("value"), "accepted", "rejected", "changes")
