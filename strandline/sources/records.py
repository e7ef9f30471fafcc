"""Files of changes, triples and questions: readers that know both layouts, and writers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schemas
from strandline.operators.triples import changes_to_triples

_CSV = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true"}


def read_csv(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """("changes" | "triples", rows): the layout is told from the header, which has `new_value` in a file of changes.

    All columns are text and stay as written ("NA" is a label, not a NULL); quotes are doubled within quotes.
    """
    header = spark.read.text(path).limit(1).collect()
    kind = "changes" if header and "new_value" in header[0][0].split(",") else "triples"
    schema = schemas.CHANGES if kind == "changes" else schemas.TRIPLES
    return kind, spark.read.options(**_CSV).schema(schema).csv(path)


def read_triples(spark: SparkSession, *paths: str) -> DataFrame:
    """The triples of the first path that exists, of either layout."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(conf).exists(place):
            kind, rows = read_csv(spark, path)
            return changes_to_triples(rows) if kind == "changes" else rows
    raise FileNotFoundError(", ".join(paths))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question records of a JSON file, a bare array or an object with `qa_pairs`; a record lacks what it doesn't have."""
    raw = spark.read.text(path, wholetext=True).select(F.ltrim("value").alias("body"))
    bare = raw.where(~F.col("body").startswith("{")).select(F.from_json("body", f"array<struct<{_fields(schemas.QA_ITEM)}>>").alias("items"))
    wrapped = raw.where(F.col("body").startswith("{")).select(
        F.from_json("body", f"struct<qa_pairs: array<struct<{_fields(schemas.QA_ITEM)}>>>")["qa_pairs"].alias("items")
    )
    return bare.unionAll(wrapped).select(F.inline("items"))


def _fields(columns: str) -> str:
    """Top-level `name type` columns as the fields of a struct type."""
    out, depth, part = [], 0, ""
    for c in columns + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(re.sub(r"^(\w+) ", r"\1: ", part.strip()))
            part = ""
        else:
            part += c
    return ", ".join(out)


def write_csv(rows: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header, quotes doubled. single: one file, for results of a bounded size."""
    (rows.coalesce(1) if single else rows).write.options(header="true", quote='"', escape='"', emptyValue="").mode("overwrite").csv(path)


def write_json_lines(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    rows.write.partitionBy(*partition_by).mode("overwrite").json(path)


def write_envelope(questions: DataFrame, path: str, metadata: dict, most: int = 10_000) -> int:
    """One JSON file {metadata, qa_pairs} with characters as they are; for the bounded result of a generator (at most `most`)."""
    items = [json.loads(r[0]) for r in questions.limit(most + 1).select(F.to_json(F.struct("*"))).collect()]
    if len(items) > most:
        raise ValueError(f"more than {most} records: use write_json_lines")
    with open(path, "w", encoding="utf-8") as file:
        json.dump({"metadata": metadata | {"total_questions": len(items)}, "qa_pairs": items}, file, ensure_ascii=False, indent=2)
    return len(items)


def evaluation_path(data_path: str, mode: str, model: str, stamp: str, kind: str = "results", search: bool = False) -> str:
    """Where an evaluation is written: outputs/evaluations/<year>/<level>_<kind>_<mode>_<model>[_search]_<stamp>.json."""
    year = re.search(r"\d{4}", data_path)
    level = re.search(r"level\d+", data_path.rsplit("/", 1)[-1])
    safe = model.translate(str.maketrans("-./", "___"))
    name = "_".join([level[0] if level else "unknown", kind, mode, safe, *["search"] * search, stamp])
    return f"outputs/evaluations/{year[0] if year else 'unknown'}/{name}.json"


def write_evaluation(scored: DataFrame, folder: str, data_path: str, mode: str, model: str, stamp: str, search: bool = False) -> dict:
    """Writes scored answers as JSON lines and a summary of one row beside them, and gives the summary."""
    name = f"{model} (search)" if search else model
    write_json_lines(scored, f"{folder}/{evaluation_path(data_path, mode, model, stamp, 'results', search)}")
    hits = F.coalesce(F.sum(F.col("matched").cast("int")), F.lit(0)).cast("int")
    summary = scored.agg(F.count(F.lit(1)).cast("int").alias("total_questions"), hits.alias("correct_answers"), F.coalesce(F.avg(F.col("matched").cast("double")), F.lit(0.0)).alias("accuracy"))
    summary = summary.select(F.lit(name).alias("model"), "*", F.lit(data_path).alias("test_file"), F.lit(stamp).alias("timestamp"))
    write_json_lines(summary, f"{folder}/{evaluation_path(data_path, mode, model, stamp, 'summary', search)}")
    return summary.first().asDict()
