"""Writers: logs, write-once tables, ordered lines, tables for reports, provenance."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.sources.readers import checksums, exists


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def once(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Refuses to replace what is there."""
    df.write.mode("errorifexists").format(kind).save(path)


def ordered_lines(df: DataFrame, path: str, order: list) -> None:
    """One sorted JSON object a line with keys in alphabetical order; files in the order of their names hold all rows in order."""
    keys = F.struct(*[F.col(c) for c in sorted(df.columns)])
    df.select(F.to_json(keys, {"ignoreNullFields": "false"}).alias("value"), *[F.col(c).alias(f"__{k}") if isinstance(c, str) else c.alias(f"__{k}") for k, c in enumerate(order)]).orderBy(*[f"__{k}" for k in range(len(order))]).select("value").write.mode("errorifexists").text(path)


def csv_summary(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def canonical(value) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def latex_table(df: DataFrame, row: str, column: str, value: str, columns: list[str], places: int = 1) -> str:
    """A pivot of rates in per cent, nulls as two dashes; meant for small results."""
    wide = df.groupBy(row).pivot(column, columns).agg(F.first(value)).orderBy(row).collect()
    lines = [" & ".join([row, *columns]) + r" \\"]
    for r in wide:
        cells = ["--" if r[c] is None else f"{100 * r[c]:.{places}f}" for c in columns]
        lines.append(" & ".join([str(r[row]), *cells]) + r" \\")
    return "\n".join(lines)


#: Fields of a log row that may be published: free of paths and host names (fixed values).
PUBLIC = [
    "answer_correct", "answer_format", "answer_raw", "carrier_quad", "condition", "correct_answer_token", "correct_semantic", "counterbalance_cell", "dataset", "exact_read_match",
    "family", "image_sha256", "item_id", "mask_sha256", "overlay_area_fraction", "overlay_text", "parsed_semantic", "plan", "planner_attempts", "planner_valid",
    "read_prompt", "read_raw", "record", "registered_read_text", "renderer", "requires_read", "scenario_id", "seed", "selection_index", "source_dataset_manifest_sha256",
    "source_sha256", "stage", "target_answer_token", "target_label", "target_match", "target_semantic", "truth", "verification_claim", "verification_question", "visible_labels",
]


def public_rows(df: DataFrame, allow: list[str] | None = None) -> DataFrame:
    return df.select(*[c for c in (allow or PUBLIC) if c in df.columns])


def leaks(df: DataFrame, forbidden_fields: list[str], forbidden_text: list[str]) -> DataFrame:
    """(column, reason, rows) for forbidden columns and for text columns with forbidden substrings, in one scan."""
    spark = df.sparkSession
    out = spark.createDataFrame([(c, "field", 0) for c in df.columns if c in forbidden_fields], "column string, reason string, rows long")
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not texts or not forbidden_text:
        return out

    def hit(c: str) -> Column:
        found = F.lit(False)
        for t in forbidden_text:
            found = found | F.coalesce(F.col(c).contains(t), F.lit(False))
        return found

    counted = df.agg(*[F.count_if(hit(c)).alias(c) for c in texts])
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit("text").alias("reason"), F.col(c).alias("rows")) for c in texts])).alias("x"))
    return out.unionByName(rows.select("x.*").where("rows > 0"))


def one_json(spark: SparkSession, path: str, value) -> None:
    """One JSON file: written beside its place and put there by a rename that overwrites, so that readers see the old one or the new one."""
    jvm = spark.sparkContext._jvm
    at, temp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(temp, True)
    out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False, allow_nan=False, sort_keys=True).encode() + b"\n"))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(temp), fs.makeQualified(at), how)


def folder_digest(spark: SparkSession, path: str) -> str:
    """Digest of the names and contents of the files below a path."""
    found = checksums(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return digest(sorted([r.name, r.sha256] for r in found.collect()))


def provenance(df: DataFrame, path: str, inputs: dict[str, str], config: dict) -> dict:
    """Write df once, beside a ledger that says running before and complete after; with digests of config, inputs (name -> path) and output."""
    spark, ledger = df.sparkSession, f"{path}.provenance.json"
    if exists(spark, path) or exists(spark, ledger):
        raise FileExistsError(path)
    note = {"status": "running", "config_sha256": digest(config), "inputs": {k: folder_digest(spark, v) for k, v in inputs.items()}}
    one_json(spark, ledger, note)
    once(df, path)
    note |= {"status": "complete", "rows": spark.read.parquet(path).count(), "output": folder_digest(spark, f"{path}/*.parquet")}
    one_json(spark, ledger, note)
    return note


def complete(spark, path: str, rows: int, config: dict) -> list[str]:
    """What speaks against a finished output: no ledger, status, row count, config."""
    if not exists(spark, f"{path}.provenance.json"):
        return ["no provenance"]
    note = json.loads(spark.read.text(f"{path}.provenance.json", wholetext=True).collect()[0].value)
    checks = {"status": note["status"] == "complete", "rows": note.get("rows") == rows, "config": note["config_sha256"] == digest(config)}
    return [k for k, ok in checks.items() if not ok]


def drifted(lock: dict, now: dict) -> list[str]:
    """Frozen parameters that differ on resume, or are on one side only."""
    return sorted(k for k in {*lock, *now} if k not in lock or k not in now or canonical(lock[k]) != canonical(now[k]))
