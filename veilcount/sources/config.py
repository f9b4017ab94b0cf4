"""Configuration of a round: bins, noise and traffic models as tables, and allocations as files.

Configuration is a few thousand names; files are read with Spark, so that they may be anywhere, and
parsed on the driver.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcount.operators.hmm import SUM_TOLERANCE

BINS = "counter string, bin_idx int, lo double, hi double"
NOISE = "counter string, sigma double, sensitivity double, estimated_value double"


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def read_yaml(spark: SparkSession, path: str) -> dict:
    """Needs PyYAML, but for files that are JSON."""
    text = read_text(spark, path)
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def bins_table(spark: SparkSession, counters: dict) -> DataFrame:
    """The bins of {counter: {bins: [[lo, hi], ...]}}; counters without bins give no rows."""
    rows = [(name, i, float(lo), float(hi)) for name, c in counters.items() for i, (lo, hi, *_) in enumerate((c or {}).get("bins") or ())]
    return spark.createDataFrame(rows, BINS)


def noise_table(spark: SparkSession, counters: dict) -> DataFrame:
    """What {counter: {sigma, sensitivity, estimated_value}} says; what it doesn't say is null."""
    number = lambda x: None if x is None else float(x)
    return spark.createDataFrame([(name, *(number((c or {}).get(k)) for k in ("sigma", "sensitivity", "estimated_value"))) for name, c in counters.items()], NOISE)


def read_config(spark: SparkSession, path: str, role: str = "tally_server") -> tuple[DataFrame, DataFrame, dict]:
    """Bins, noise and the privacy parameters of a round.

    Bins come from the role's counters file, else inline. Noise comes from the first of: its noise
    file, inline privacy with counters, its sigmas file, inline counters. Without parameters, the
    sigmas are given and the last result is empty.
    """
    whole = read_yaml(spark, path)
    own = whole.get(role) or {}
    inline = whole.get("counters") or {}
    bins = read_yaml(spark, own["counters"])["counters"] if "counters" in own else inline
    privacy: dict = {}
    if "noise" in own:
        noise = read_yaml(spark, own["noise"])
        privacy, noise = noise["privacy"], noise["counters"]
    elif "privacy" in whole and "counters" in whole:
        privacy, noise = whole["privacy"], inline
    elif "sigmas" in own:
        noise = read_yaml(spark, own["sigmas"])["counters"]
    else:
        noise = inline
    return bins_table(spark, bins), noise_table(spark, noise), privacy


def write_allocation(allocation: DataFrame, privacy: dict, path: str) -> None:
    """K4: an allocation (counter, sigma, ...) with its parameters as one object, which read_config reads as noise."""
    fields = [c for c in allocation.columns if c != "counter"]
    counters = {r["counter"]: {c: r[c] for c in fields} for r in allocation.orderBy("counter").collect()}
    text = json.dumps({"counters": counters, "privacy": privacy}, indent=4, sort_keys=True)
    allocation.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


#: What each observation emits: the end a probability alone, others also mean, deviation and rate.
PARTS = {"F": 1, "$": 4, "+": 4, "-": 4}
SPACES = ("state_space", "observation_space", "start_probability", "transition_probability", "emission_probability")


def model_problems(model: dict, kind: str = "packet_model") -> list[str]:
    """Why a part of a traffic model isn't valid; empty where it is."""
    if not isinstance(model, dict) or (missing := [k for k in SPACES if k not in model]):
        return [f"no {k}" for k in (missing if isinstance(model, dict) else SPACES)]
    states, observed = set(model["state_space"]), set(model["observation_space"])
    out = [f"no observation {o}" for o in (("+", "-", "F") if kind == "packet_model" else ("$", "F")) if o not in observed]

    def sums(name: str, found: dict, exempt: bool = False) -> None:
        if not exempt and not math.isclose(sum(found.values()), 1.0, rel_tol=SUM_TOLERANCE):
            out.append(f"{name} doesn't sum to 1")

    def known(names, space: set[str], what: str) -> None:
        out.extend(f"unknown {what} {x}" for x in names if x not in space)

    known(model["start_probability"], states, "state")
    sums("start", {k: float(v) for k, v in model["start_probability"].items()})
    for src, to in model["transition_probability"].items():
        known([src, *to], states, "state")
        sums(f"transition of {src}", {k: float(v) for k, v in to.items()}, "End" in src)
    for state, sent in model["emission_probability"].items():
        known([state], states, "state")
        known(sent, observed, "observation")
        out.extend(f"emission of {state} {o} has {len(v)} parts" for o, v in sent.items() if len(v) != PARTS.get(o, len(v)))
        sums(f"emission of {state}", {o: float(v[0]) for o, v in sent.items() if v})
    return out


def read_model(spark: SparkSession, path: str) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The transitions and emissions of each part of a traffic model, as model_counters takes them.

    A part that isn't valid, or a file without parts, raises ValueError.
    """
    whole = json.loads(read_text(spark, path))
    parts = {k: whole[k] for k in ("packet_model", "stream_model") if k in whole}
    problems = [f"{k}: {p}" for k, m in parts.items() for p in model_problems(m, k)] if parts else ["no model"]
    if problems:
        raise ValueError("; ".join(problems))
    out = {}
    for kind, m in parts.items():
        moves = [("START", s, float(p)) for s, p in m["start_probability"].items()] + [(s, d, float(p)) for s, to in m["transition_probability"].items() for d, p in to.items()]
        sent = [(s, o, *([float(x) for x in v] + [0.0] * 3)[:4]) for s, e in m["emission_probability"].items() for o, v in e.items()]
        out[kind] = spark.createDataFrame(moves, "src string, dst string, p double"), spark.createDataFrame(sent, "state string, obs string, dp double, mu double, sigma double, lam double")
    return out


def latest_model(spark: SparkSession, folder: str) -> str | None:
    """K1: the valid model file of the latest round in the folder. Shared stores have no links, so it is looked up."""
    ended = F.regexp_extract(F.col("_metadata.file_path"), r"traffic\.model\.\d+-(\d+)\.json", 1).try_cast("long")
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(ended.alias("ended"), F.col("_metadata.file_path").alias("path")).where("ended is not null").distinct()
    for row in files.orderBy(F.desc("ended"), "path").toLocalIterator():
        try:
            read_model(spark, row["path"])
        except ValueError:
            continue
        return row["path"]
    return None
