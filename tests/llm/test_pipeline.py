"""The whole pipeline over documents with nulls, empty, repeated and very long rows, and columns named as the stages name theirs."""

import re
from pathlib import Path

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Every name that the stages' modules give to a column, as a column of documents."""
    code = "".join((ROOT / "veilcount/llm" / f"{m}.py").read_text() for m in ("quality", "neardup", "secrets", "mixing", "packing", "lookup", "components"))
    taken = {"doc_id", "text", "lang", "source", "n_chars"}
    names = sorted({n for n in re.findall(r'"([a-z_][a-z_0-9]*)"', code) if n.lower() not in taken})
    assert {"_row", "kept_id", "component_id"} <= set(names)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(None, None, None, None, None), (None, "", "en", "web", 0), (9000, "word " * 400_000, "en", None, None), (9001, "a \x00 b", "en", "web", 5)]
    more += [(9002, "same text in a row that recurs. " * 30, "en", s, None) for s in ("web", "books", "books", None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs.selectExpr("*", *[f"'x' AS {n}" for n in names]).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages_in_order(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), name)
        assert docs.columns == columns
        counts.append(docs.count())
    rows = docs.collect()
    assert counts[0] > counts[1] > counts[2] == counts[3] and rows
    assert not any(re.search(r"AKIA[A-Z0-9]{14}", r["text"] or "") for r in rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
    whole = corpus_pipeline.run(spark, folder).collect()
    shown = lambda found: sorted(str((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"])) for p in found)
    assert shown(whole) == shown(pieces)  # a second run agrees with the first
