"""Readers of manifests, logs and annotation sets, all lazy and with explicit schemas where the caller has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairlens.operators.durable import kept


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, strict: bool = True, missing_ok: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped.

    strict: a malformed line fails the query.  missing_ok: a path that does not
    exist is an empty table (a schema is needed then).
    """
    if missing_ok and isinstance(path, str) and not exists(spark, path):
        if schema is None:
            raise ValueError("an empty table needs a schema")
        return spark.createDataFrame([], schema)
    r = spark.read.option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return (r.schema(schema) if schema is not None else r).json(path)


def json_or_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array in one file, or one object a line, told apart by the first character; empty input is an error."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not head:
        raise ValueError(f"{path} holds no rows")
    array = head[0].value.lstrip("﻿ \t").startswith("[")
    r = spark.read.option("mode", "FAILFAST").option("multiLine", array)
    return (r.schema(schema) if schema is not None else r).json(path)


def csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("mode", "FAILFAST").option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema is not None else r).csv(path)


def parquet(spark: SparkSession, path: str, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Parquet, or of it the columns asked for: new name -> names it may have in the file, the first found is taken."""
    df = spark.read.parquet(path)
    if columns is None:
        return df
    picked = []
    for name, options in columns.items():
        found = [o for o in options if o in df.columns]
        if not found:
            raise ValueError(f"none of {options} in {path}")
        picked.append(F.col(found[0]).alias(name))
    return df.select(*picked)


def coco(spark: SparkSession, path: str) -> DataFrame:
    """One row an annotation: image id and file, category name, area, box."""
    schema = "images array<struct<id:long,file_name:string,width:int,height:int>>, categories array<struct<id:int,name:string>>, annotations array<struct<id:long,image_id:long,category_id:int,area:double,bbox:array<double>>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("__file", F.input_file_name())
    part = lambda c: doc.select("__file", F.explode(c).alias("x")).select("__file", "x.*")
    images = part("images").withColumnRenamed("id", "image_id")
    names = part("categories").select("__file", F.col("id").alias("category_id"), F.col("name").alias("label"))
    # ids belong to their file
    return part("annotations").withColumnRenamed("id", "annotation_id").join(images, ["__file", "image_id"]).join(names, ["__file", "category_id"]).drop("__file")


def yolo(spark: SparkSession, path: str) -> DataFrame:
    """Lines of class, centre x, centre y, width, height; lines that are short or no numbers are left out."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 5)
    number = lambda k: F.col("p")[k].try_cast("double")
    rows = lines.select("file", F.col("p")[0].try_cast("int").alias("class_id"), number(1).alias("cx"), number(2).alias("cy"), number(3).alias("w"), number(4).alias("h"))
    return rows.dropna().withColumn("area", F.col("w") * F.col("h"))


def voc(spark: SparkSession, path: str) -> DataFrame:
    """One row an object of annotation XML: file, size, name, box and its area."""
    box = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    schema = f"filename string, size struct<width:int,height:int>, object array<struct<name:string,bndbox:{box}>>"
    doc = spark.read.format("xml").option("rowTag", "annotation").schema(schema).load(path)
    o = doc.select("filename", "size.width", "size.height", F.explode("object").alias("o")).select("filename", "width", "height", F.col("o.name").alias("name"), "o.bndbox.*")
    return o.withColumn("area", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lines, blank ones left out."""
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''").distinct()


def shards(spark: SparkSession, glob: str, schema: T.StructType | str) -> DataFrame:
    """Rows of all files that match, with the file and its place in sorted order."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(glob).withColumn("file", F.input_file_name())
    order = df.select("file").distinct().agg(F.array_sort(F.collect_set("file")).alias("__files"))
    return df.join(F.broadcast(order), F.lit(True)).withColumn("shard", F.array_position("__files", F.col("file")) - 1).drop("__files")


#: Kinds of JSON values that stand for an id.
SCALARS = ["STRING", "BIGINT"]


def json_documents(spark: SparkSession, path: str, names: str = "*.json*") -> DataFrame:
    """(file, v): the JSON values of all files of such names below a path as variants: one a line where every line is a value, else one a file.

    A file that is neither fails the query with its name.  (Spark's parser ends
    behind the first value, so a file is only taken whole if its lines are none.)
    """
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    parsed = text.select("file", "value", F.transform(lines, F.try_parse_json).alias("lines"))
    by_line = F.forall("lines", lambda v: v.isNotNull())
    whole = F.coalesce(F.try_parse_json("value"), F.raise_error(F.concat(F.lit("no JSON in "), F.col("file"))).cast("variant"))
    return parsed.select("file", F.explode(F.when(by_line, F.col("lines")).otherwise(F.array(whole))).alias("v"))


def below(nodes: DataFrame) -> DataFrame:
    """The direct children of JSON values (file, v, and the list rule `ids` that holds in a value): file, role, v.

    A role says what a child is to its parent: `sample` (the field sample_id),
    `ids` (an element of a list in a field that ends in _ids), `listed` (an element
    of another list), `field`.
    """
    nodes.createOrReplaceTempView("__nodes")
    children = nodes.sparkSession.sql("select n.file, n.role as parent, e.key, e.value as v from __nodes n, lateral variant_explode(n.v) e")
    is_list = F.schema_of_variant("v").startswith("ARRAY")
    role = (
        F.when(F.col("parent") == "id list", "ids").when(F.col("key").isNull(), "listed").when(F.col("key") == "sample_id", "sample")
        .when(F.col("key").endswith("_ids") & is_list, "id list").otherwise("field")
    )
    return children.select("file", role.alias("role"), "v")


def harvest_ids(spark: SparkSession, path: str, pattern: str = r"coco-\d{12}", prefix: str = "coco-", names: str = "*.json*") -> DataFrame:
    """(file, id, n): ids in nested JSON files (or files of JSON lines) below a path, and how often.

    Ids are the values of sample_id fields, the elements of lists in fields that
    end in _ids, and elements of any list that begin with the prefix; all must
    match the whole pattern.  Values are walked level by level as rows: no file
    becomes one Python object, and a level's rows are written before the next.
    """
    nodes, found = json_documents(spark, path, names).select("file", F.lit("field").alias("role"), "v"), None
    while True:
        children = kept(below(nodes), "level")
        text, kind = F.col("v").cast("string"), F.schema_of_variant("v")
        is_id = kind.isin(*SCALARS) & (F.col("role").isin("sample", "ids") | ((F.col("role") == "listed") & text.startswith(prefix)))
        hit = children.where(is_id & text.rlike(rf"\A(?:{pattern})\z")).select("file", text.alias("id"))
        found = hit if found is None else found.unionByName(hit)
        # the values of sample_id fields and of id lists hold nothing else
        nodes = children.where(~F.col("role").isin("sample", "ids") & ~kind.isin(*SCALARS))
        if children.isEmpty():
            break
    return found.groupBy("file", "id").agg(F.count("*").alias("n"))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def variants(spark: SparkSession, path: str, schema: T.StructType | str, field: str = "variants") -> DataFrame:
    """Files of one item each with an array of variants: a row a variant."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    rest = [c for c in df.columns if c != field]
    return df.select(*rest, F.explode(field).alias("__v")).select(*rest, "__v.*")


READERS: dict[str, Callable[..., DataFrame]] = {"jsonl": jsonl, "json": json_or_jsonl, "csv": csv, "parquet": parquet, "coco": coco, "yolo": yolo, "voc": voc}


def load(spark: SparkSession, kind: str, path: str, include: DataFrame | None = None, exclude: DataFrame | None = None, key: str = "id", n: int | None = None, order: list | None = None, **options) -> DataFrame:
    """Read by registered kind, filter by id tables, and take exactly n rows in order if asked for."""
    df = READERS[kind](spark, path, **options)
    if include is not None:
        df = df.join(include, key, "left_semi")
    if exclude is not None:
        df = df.join(exclude, key, "left_anti")
    if n is not None:
        df = df.orderBy(*(order or [key])).limit(n)
        if (got := df.count()) != n:
            raise ValueError(f"{got} rows, {n} were asked for")
    return df
