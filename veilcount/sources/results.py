"""Files of published results: tallies alone, or tallies with the context of their round."""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bins are read as texts: counts may exceed doubles, and ends may be infinite, quoted or not.
TALLIES = "map<string, struct<bins: array<array<string>>, sigma: double>>"
CONTEXT = "struct<TallyServer: struct<Config: struct<noise: struct<privacy: map<string, string>, counters: map<string, struct<sigma: double>>>>>>"


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Experiment (the file), counter, bin_idx, lo, hi, value, sigma, excess; one file an experiment.

    Counters are map keys, so the schema doesn't depend on their names. Without a context, sigma is the
    tally's own, where it has one, and excess is null.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("experiment"), "value")
    top = files.withColumn("top", F.from_json("value", "map<string, string>"))
    has_context = F.map_contains_key("top", "Context")
    parsed = top.select("experiment", F.from_json(F.when(F.map_contains_key("top", "Tally"), F.col("top")["Tally"]).otherwise(F.col("value")), TALLIES).alias("tallies"), has_context.alias("has_context"), F.from_json(F.col("top")["Context"], CONTEXT)["TallyServer"]["Config"]["noise"].alias("noise"))
    counters = parsed.select("experiment", "has_context", "noise", F.explode("tallies").alias("counter", "tally"))
    bins = counters.select("*", F.posexplode("tally.bins").alias("bin_idx", "bin"))
    part = lambda i: F.translate(F.get("bin", F.lit(i)), '"', "")
    sigma = F.when(F.col("has_context"), F.col("noise.counters")[F.col("counter")]["sigma"]).otherwise(F.col("tally.sigma"))
    return bins.select("experiment", "counter", "bin_idx", part(0).try_cast("double").alias("lo"), part(1).try_cast("double").alias("hi"), part(2).try_cast("decimal(38,0)").alias("value"), sigma.alias("sigma"), F.col("noise.privacy")["excess_noise_ratio"].try_cast("double").alias("excess"))


def results_name(kind: str, begin: float, end: float) -> str:
    """K1: kind is tallies, outcome or the like; times in whole seconds."""
    return f"{kind}.{round(begin)}-{round(end)}.json"


def tallied(results: DataFrame) -> DataFrame:
    """K1: results (counter, bin_idx, lo, hi, value) as one row with one JSON object, counters and bins in order.

    The object has one entry for each configured counter, whatever the number of events.
    """
    parts = F.array(*[F.col(c).cast("string") for c in ("lo", "hi", "value")])
    bins = F.array_sort(F.collect_list(F.struct("bin_idx", parts.alias("bin"))))
    each = results.groupBy("counter").agg(F.struct(F.transform(bins, lambda x: x["bin"]).alias("bins")).alias("tally"))
    entries = F.array_sort(F.collect_list(F.struct("counter", "tally")))
    return each.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def write_results(results: DataFrame, folder: str, begin: float, end: float) -> str:
    """K1: the tallies alone."""
    path = f"{folder}/{results_name('tallies', begin, end)}"
    tallied(results).coalesce(1).write.text(path)
    return path


def context_of(noise: DataFrame, privacy: dict, start: float, stopping: float, end: float, padding: float = 0.0, **more):
    """K1: the context of a round: its times, its noise (counter, sigma, configuration) and what the caller adds.

    more: parts beside these, such as DataCollector or ShareKeeper; those of TallyServer are merged.
    """
    sigmas = {r["counter"]: {"sigma": r["sigma"]} for r in noise.select("counter", "sigma").collect()}
    server = dict(more.pop("TallyServer", {}))
    server["Config"] = server.get("Config", {}) | {"noise": {"privacy": privacy, "counters": sigmas}}
    times = {
        "Start": start,
        "Stopping": stopping,
        "End": end,
        "CollectStopping": stopping - start,
        "CollectEnd": end - start,
        "StoppingDelay": end - stopping,
        "ClockPadding": padding,
    }
    return more | {"Time": times, "TallyServer": server}


def _paths(*names: str) -> dict[str, str]:
    return {f"Config.{n}": f"({n} path)" for n in names}


#: What contexts don't tell of parties, and what stands there instead. A * is every name.
_START = {"Config.Start.counters": "(counter bins, no counts)", "Config.Start.noise.counters": "(counter sigmas, no counts)"}
HIDDEN = {
    "DataCollector": _paths("state", "secret_handshake") | _START | {"Config.Start.sharekeepers.*": "(public key)"},
    "ShareKeeper": _paths("key", "state", "secret_handshake") | _START | {"Status.public_key": "(public key)"},
    "TallyServer": _paths("cert", "key", "state", "secret_handshake", "allocation", "results") | {"Config.counters": "(counter bins, no counts)"},
}


def _hide(part: object, path: list[str], text: str) -> None:
    name, *rest = path
    if not isinstance(part, dict):
        return
    for own in list(part) if name == "*" else [name] if name in part else []:
        if rest:
            _hide(part[own], rest, text)
        else:
            part[own] = text


def cleaned(context: dict) -> dict:
    """K1: a context without paths, keys, and counters that the tallies tell anyway. What isn't there stays away."""
    out = copy.deepcopy(context)
    for kind, hidden in HIDDEN.items():
        for path, text in hidden.items():
            _hide(out, [kind, *([] if kind == "TallyServer" else ["*"]), *path.split(".")], text)
    return out


def client_contexts(clients: DataFrame, configs: dict[str, dict] | None = None) -> dict:
    """K1: for context_of, by kind: the Status of each client (a row of operators/clients.py's registry) and its Config, if any.

    Clients without a kind aren't told. A round has as many clients as it has parties: configuration, not data.
    """
    out: dict = {}
    for row in clients.where("kind is not null").toLocalIterator():
        status = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
        name, kind = str(status.pop("client")), status.pop("kind")
        config = {"Config": configs[name]} if name in (configs or {}) else {}
        out.setdefault(kind, {})[name] = {"Status": status} | config
    return out


def write_outcome(results: DataFrame, context: dict, folder: str, begin: float, end: float) -> str:
    """K1: tallies with the cleaned context of their round; read_results and read_contexts read them."""
    told = F.lit('{"Context":' + json.dumps(cleaned(context), sort_keys=True) + ',"Tally":')
    path = f"{folder}/{results_name('outcome', begin, end)}"
    tallied(results).select(F.concat(told, "value", F.lit("}")).alias("value")).coalesce(1).write.text(path)
    return path


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """K1: experiment, kind, client, part (Status or Config), field, value of clients in contexts; nested values stay JSON."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("experiment"), F.from_json("value", "map<string, string>")["Context"].alias("context"))
    kinds = files.select("experiment", F.explode(F.from_json("context", "map<string, string>")).alias("kind", "told")).where(~F.col("kind").isin("Time", "TallyServer"))
    clients = kinds.select("experiment", "kind", F.explode(F.from_json("told", "map<string, map<string, map<string, string>>>")).alias("client", "parts"))
    fields = clients.select("experiment", "kind", "client", F.explode("parts").alias("part", "fields"))
    return fields.select("experiment", "kind", "client", "part", F.explode("fields").alias("field", "value"))
