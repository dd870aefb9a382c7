"""Queries that build questions, options, answers and settings from the columns of tables, and score them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pairlens.functions import answers as A
from pairlens.functions import hashing as H
from pairlens.functions import text as T
from pairlens.functions import text_exact as X
from pairlens.functions.stats import rate_record
from pairlens.operators.durable import scratch
from pairlens.plans.views import dealt, sql_bucket, table
from pairlens.sources import readers, writers

QUERIES, ORACLE_SQL = {}, {}


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def parts(spark, sf_dir, seed: str, kinds: int):
    p = dealt(table(spark, sf_dir, "part")).select("p_partkey", "p_size", F.col("p_name").alias("name"), F.lower("p_type").alias("type"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("brand"))
    return p.withColumn("kind", H.bucket(kinds, seed, F.col("p_partkey")))


def parts_sql(seed: str, kinds: int) -> str:
    return f"""p as (select p_partkey, p_size, p_name as name, lower(p_type) as type, lower(replace(p_brand, '#', ' ')) as brand, {sql_bucket(kinds, f"'{seed}'", "p_partkey")} as kind from part)"""


def by_kind(*texts):
    """The text of a row's kind."""
    return F.element_at(F.array(*texts), (F.col("kind") + 1).cast("int"))


def parallel(*parts_):
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts_])


@query(f"""with {parts_sql("say", 6)}, s as (select *, case kind when 0 then 'a' when 1 then 'b' when 2 then 'c' when 3 then 'a' when 4 then case when contains(name, type) then 'a' else 'c' end end as letter from p)
    select p_partkey, 3 as options, letter, (coalesce(letter, '') = 'a')::int::double as choice, kind in (1, 3) as target,
        case p_partkey % 3 when 0 then (kind = 3)::int::double when 1 then (kind in (0, 3))::int::double else (kind = 4 and type = name)::int::double end as public,
        p_size % 2 = 0 as label, p_size % 2 = 0 or p_size % 3 = 0 as alias, case p_size % 4 when 0 then 'color' when 1 then 'count' when 2 then 'count' else 'unsupported' end as task from s""")
def question_scores(spark, sf_dir):
    """Questions on parts with options from their columns: options read, letters of answers, and every score of the answer."""
    n, t, b = F.col("name"), F.col("type"), F.col("brand")
    p = parts(spark, sf_dir, "say", 6).withColumn("question", parallel("What is this? (a) ", n, " (b) ", b, " (c) ", t, ". Answer with a letter"))
    p = p.withColumn("said", by_kind(F.lit("The answer is (a)"), F.lit("Option: b."), F.lit("I saw (c)."), parallel("It is a ", n, "!"), F.upper(t), F.lit("no idea")))
    # options and letter are columns of their own, so that each is read once a row
    p = p.withColumn("read", A.options_in(F.col("question")))
    options = F.col("read")
    p = p.withColumn("letter", A.prediction_letter(F.col("said"), options))
    dataset = F.element_at(F.array(F.lit("VQAv2"), F.lit("typo_base_x"), F.lit("other")), (F.col("p_partkey") % 3 + 1).cast("int"))
    gold = F.when(F.col("p_partkey") % 3 == 1, F.array(F.lit("a"))).otherwise(F.array(n))
    seen = F.when(F.col("p_size") % 2 == 0, F.concat(n, F.lit("s"))).when(F.col("p_size") % 3 == 0, t).otherwise(b)
    task = A.task_type(F.lit(None).cast("string"), F.element_at(F.array(F.lit("Color of it"), F.lit("counting"), F.lit(""), F.lit("")), (F.col("p_size") % 4 + 1).cast("int")), F.lit("Say"), F.when(F.col("p_size") % 4 == 2, F.array(F.col("p_size").cast("string"))).otherwise(F.array(n)))
    return p.select(
        "p_partkey", F.size(options).alias("options"), "letter", A.letter_score(F.col("letter"), n, options).alias("choice"),
        A.target_matches_any(F.col("said"), F.array(F.lit("b"), n)).alias("target"), A.public_score(F.col("said"), gold, F.col("question"), dataset).alias("public"),
        T.label_match(seen, n).alias("label"), A.alias_label_match(seen, n, F.create_map(n, F.array(n, t))).alias("alias"), task.alias("task"),
    )


@query(f"""with {parts_sql("strict", 6)} select p_partkey, case kind when 0 then 'TRUE' when 5 then 'FALSE' end as verdict, case kind when 0 then name when 5 then type end as claim,
        case kind when 0 then 'A' when 1 then 'B' when 3 then 'C' when 5 then case when not contains(name, type) then 'A' end end as option, case kind when 0 then 'no' when 1 then 'yes' when 2 then 'yes' when 3 then 'no' else 'invalid' end as semantic from p""")
def strict_answers(spark, sf_dir):
    """Strict verdicts, options that an answer commits to, and semantic answers, over texts made of the columns of parts."""
    n, t, b = F.col("name"), F.col("type"), F.col("brand")
    p = parts(spark, sf_dir, "strict", 6)
    body = by_kind(parallel('{"claim": "', n, '", "verdict": "TRUE"}'), parallel('{"claim": "', n, '", "verdict": "MAYBE"}'), parallel('{"claim": ', F.col("p_size").cast("string"), ', "verdict": "TRUE"}'), parallel('{"claim": "', n, '"}'), parallel("It says ", n), parallel('```json\n{"claim": "', t, '", "verdict": "FALSE"}\n```'))
    raw = by_kind(F.lit("(a)."), F.lit("Answer: B"), F.lit("A or B"), parallel(F.upper(t), "."), parallel("Answer: A, not ", b), parallel("Final answer: ", n, "!"))
    said = by_kind(F.lit("A"), F.lit("(b) it is"), parallel("yes, a ", n), F.lit("NO"), parallel("the ", n), F.lit(""))
    form, order = F.when(F.col("kind") < 2, "ab").otherwise("yesno"), F.when(F.col("kind") < 2, "no_yes").otherwise("yes_no")
    strict = T.strict_object(body, ["claim", "verdict"], "verdict", ["TRUE", "FALSE"])
    return p.select("p_partkey", strict["verdict"].alias("verdict"), strict["claim"].alias("claim"), X.conservative_choice(raw, F.array(n, b, t)).alias("option"), T.semantic_answer(said, form, order).alias("semantic"))


@query(f"""with {parts_sql("read", 4)}, w as (select *, string_split(name, ' ') as ws from p), o as (select *, list_distinct(list_filter(ws || ['red'], lambda x: length(x) > 1 and x not in ('a', 'an', 'the', 'this', 'is', 'of', 'or', 'and', 'to', 'at', 'in', 'with', 'can', 'after'))) as want from w)
    select p_partkey, 't -' || p_size || '.5 +/- 0.5 m2' as written, p_size % 2 = 0 as same, 'at ' || p_size || ' degrees c ' || name as plain, kind in (0, 1) as inside, kind in (0, 2) as all_there,
        case when kind = 3 then false else len(list_intersect(want, case when kind = 0 then ws else ws[1:1] end))::double / len(want) >= 0.5 end as claim, 'SOURCE ' || p_size || '.5 GAL' as canonical, upper(ws[1]) || '-' || ws[2] as shown, ws[2] = 'ring' as conflicts from o""")
def text_rules(spark, sf_dir):
    """Transcriptions with their signs, normal texts, registered fields, claims, canonical numbers and conflicts, over texts made of the columns of parts."""
    n, size = F.col("name"), F.col("p_size").cast("string")
    p = parts(spark, sf_dir, "read", 4)
    first, second = F.element_at(F.split(n, " "), 1), F.element_at(F.split(n, " "), 2)
    other = F.when(F.col("p_size") % 2 == 0, parallel("-", size, ".5 C")).otherwise(parallel(size, ".5 C"))
    seen = by_kind(parallel("It says: ", n, ", ", size), parallel("see ", n), parallel(size, " on ", first, " -- ", second), F.lit("none of it"))
    claim = by_kind(n, first, first, F.lit("NONE"))
    return p.select(
        "p_partkey", X.transcription(parallel("T = −", size, ".5 ± 0.5 m²")).alias("written"), X.same_transcription(parallel("−", size, ".5 c"), other).alias("same"),
        A.normalize_text(parallel("At ", size, "°C: ", n)).alias("plain"), A.transcription_match(by_kind(parallel("reads ", n), n, first, F.lit("no text")), n).alias("inside"),
        T.all_present(seen, F.array(n, size)).alias("all_there"), A.overlay_claim_match(claim, parallel("the ", n, " is red")).alias("claim"),
        A.canonical_line(parallel("source  +0", size, ".50 usgal")).alias("canonical"), T.kept_segments(parallel(F.upper(first), "-", second, " | STATUS ok"), "^STATUS").alias("shown"),
        A.contradicts_scene(parallel("A ", n, " here"), F.lit("ring"), F.lit("cup"), F.array(F.lit("mat"))).alias("conflicts"),
    )


@query("""select 'coco' as kind, p_partkey as key, p_brand as label, p_size::double as area from part union all select 'yolo', p_partkey, (p_size % 5)::varchar, round(p_size / 100.0 * 0.5, 9) from part where p_size % 7 > 0
    union all select 'voc', p_partkey, p_type, (p_size * 2)::double from part union all select 'ids', p_partkey, 'id', null from part union all select 'variants', p_partkey, 'k' || k, k * p_size::double from part, (select unnest([1, 2]) as k)""")
def annotation_round_trips(spark, sf_dir):
    """Parts written as annotation files of each kind, and read back by the reader of the kind; short lines and repeated ids are in the files."""
    p = table(spark, sf_dir, "part").withColumn("file", F.col("p_partkey") % 4)
    at = {k: scratch(spark, k) for k in ("coco", "yolo", "voc", "ids", "variants")}
    text = lambda df, k: df.write.partitionBy("file").text(at[k])
    c = p.select("file", F.struct(F.col("p_partkey").alias("id"), F.concat(F.col("p_partkey"), F.lit(".jpg")).alias("file_name")).alias("i"), F.struct(F.xxhash64("p_brand").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("id"), F.col("p_brand").alias("name")).alias("c"), F.col("p_size"))
    # the images and boxes of a file are those of one of its blocks of parts, so no file holds more than a block
    blocks = c.withColumn("block", F.floor(F.col("i.id") / 1000)).groupBy("file", "block").agg(F.collect_list("i").alias("images"), F.collect_set("c").alias("categories"), F.collect_list(F.struct(F.col("i.id").alias("id"), F.col("i.id").alias("image_id"), F.col("c.id").alias("category_id"), F.col("p_size").cast("double").alias("area"), F.array(F.lit(0.0), F.lit(0.0), F.col("p_size").cast("double"), F.lit(1.0)).alias("bbox"))).alias("annotations"))
    text(blocks.select(F.to_json(F.struct("images", "categories", "annotations")).alias("value"), F.concat_ws("-", "file", "block").alias("file")), "coco")
    line = F.concat_ws(" ", (F.col("p_size") % 5).cast("string"), F.lit("0.5"), F.col("p_partkey").cast("string"), F.concat((F.col("p_size") / 100).cast("string")), F.when(F.col("p_size") % 7 > 0, "0.5"))
    text(p.select(line.alias("value"), "file"), "yolo")
    one = F.concat(F.lit("<annotation><filename>"), F.col("p_partkey"), F.lit("</filename><size><width>9</width><height>9</height></size><object><name>"), F.col("p_type"), F.lit("</name><bndbox><xmin>1</xmin><ymin>0</ymin><xmax>3</xmax><ymax>"), F.col("p_size"), F.lit("</ymax></bndbox></object></annotation>"))
    files = p.groupBy("file", F.floor(F.col("p_partkey") / 1000).alias("block")).agg(F.array_join(F.collect_list(one), "").alias("rows"))
    text(files.select(F.concat(F.lit("<annotations>"), "rows", F.lit("</annotations>")).alias("value"), F.concat_ws("-", "file", "block").alias("file")), "voc")
    text(p.select(F.explode(F.array(F.col("p_partkey").cast("string"), F.concat(F.lit(" "), F.col("p_partkey")), F.lit(" "))).alias("value"), "file"), "ids")
    text(p.select(F.to_json(F.struct(F.col("p_partkey").alias("item"), F.array(*[F.struct(F.lit(k).alias("k"), (k * F.col("p_size")).alias("v")) for k in (1, 2)]).alias("variants"))).alias("value"), "file"), "variants")
    coco = [readers.coco(spark, f"{at['coco']}/*").select(F.lit("coco").alias("kind"), F.col("annotation_id").alias("key"), "label", "area")]
    coco.append(readers.yolo(spark, f"{at['yolo']}/*").select(F.lit("yolo"), F.col("cy").cast("long"), F.col("class_id").cast("string"), F.round("area", 9)))
    coco.append(readers.voc(spark, f"{at['voc']}/*").select(F.lit("voc"), F.col("filename").cast("long"), "name", "area"))
    coco.append(readers.id_list(spark, f"{at['ids']}/*").select(F.lit("ids"), F.col("id").cast("long"), F.lit("id"), F.lit(None).cast("double")))
    variants = spark.read.schema("item long, variants array<struct<k:int,v:double>>").json(f"{at['variants']}/*").select("item", F.inline("variants"))
    coco.append(variants.select(F.lit("variants"), "item", F.concat(F.lit("k"), "k"), "v"))
    out = coco[0]
    for df in coco[1:]:
        out = out.union(df)
    return out


@query("""with e as (select event_id as k, user_id as u from events), ids as (select k as id from e union all select k + 1 from e union all select u from e union all select u from e union all select k + 3 from e)
    select 'coco-' || lpad(id::varchar, 12, '0') as id, count(*) as n from ids group by id""")
def harvested_ids(spark, sf_dir):
    """Ids from nested JSON made of events: a field, a list of ids, lists in lists; other texts that look like ids do not count."""
    name = lambda c: F.format_string("coco-%012d", c)
    k, u = F.col("event_id"), F.col("user_id")
    inner = F.struct(F.array(F.struct(name(k + 1).alias("sample_id"), name(k + 2).alias("note")), F.struct(name(k + 3).alias("sample_id"), F.lit("coco-1").alias("note"))).alias("list"), F.col("props").alias("props"))
    doc = F.struct(name(k).alias("sample_id"), F.array(name(u), name(u), F.lit("x")).alias("eligible_ids"), inner.alias("deep"), name(k + 9).alias("other"))
    path = scratch(spark, "nested")
    table(spark, sf_dir, "events").select(F.to_json(doc).alias("value"), (k % 8).alias("part")).write.partitionBy("part").option("compression", "none").text(path)
    return readers.harvest_ids(spark, path, names="*.txt").groupBy("id").agg(F.sum("n").alias("n"))


@query("""with r as (select lang, count(*) filter (quality = 1) as k, count(quality) as n from documents left join labels using (doc_id) group by lang)
    select lang, k, n, round(k::double / nullif(n, 0), 9) as rate, case when n > 0 then round(greatest(0, ((k::double / n + 3.841458820694124 / (2 * n)) - 1.959963984540054 * sqrt(k::double / n * (1 - k::double / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)), 9) end as low from r""")
def rate_records(spark, sf_dir):
    """Good documents among labelled ones by language, as records of counts, rate and interval."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    r = table(spark, sf_dir, "documents").join(lab, "doc_id", "left").groupBy("lang").agg(rate_record(F.count_if(F.col("quality") == 1), F.count("quality")).alias("r"))
    return r.select("lang", "r.k", "r.n", F.round("r.rate", 9).alias("rate"), F.round("r.low", 9).alias("low"))


@query("""select doc_id, regexp_replace(regexp_replace(source || '/' || lang || ' ' || doc_id, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substr(sha256(source || '/' || lang || ' ' || doc_id), 1, 10) as slug from documents""")
def safe_slugs(spark, sf_dir):
    """File-safe names of documents."""
    return table(spark, sf_dir, "documents").select("doc_id", H.slug(F.concat("source", F.lit("/"), "lang", F.lit(" "), F.col("doc_id").cast("string"))).alias("slug"))


@query("""select 'truth' as "column", 'text' as reason, count(*) filter (contains(text, 'http')) as rows from (select text from documents) having count(*) filter (contains(text, 'http')) > 0
    union all select 'doc_id', 'field', 0""")
def release_leaks(spark, sf_dir):
    """Fields and texts that may not be published, of documents whose text stands under a published name."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("truth"), "lang")
    return writers.leaks(d, ["doc_id", "host"], ["http"])


@query("select n_regionkey as n_regionkey, n_name as n_name, case n_regionkey % 3 when 0 then '' when 1 then 'rows' else 'rows,config' end as against, false as drifted from nation")
def provenance_audit(spark, sf_dir):
    """Nations written with a ledger, and what speaks against the output for a right request, one with another count and one with another setting too."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    path, source, rows = scratch(spark, "released"), scratch(spark, "source"), n.count()
    writers.once(n, source)
    writers.provenance(n, path, {"nation": f"{source}/*.parquet"}, {"seed": 7})
    found = [writers.complete(spark, path, rows, {"seed": 7}), writers.complete(spark, path, rows + 1, {"seed": 7}), writers.complete(spark, path, rows + 1, {"seed": 8})]
    said = F.element_at(F.array(*[F.lit(",".join(x)) for x in found]), (F.col("n_regionkey") % 3 + 1).cast("int"))
    return readers.parquet(spark, path).withColumns({"against": said, "drifted": F.lit(bool(writers.drifted({"seed": 7}, {"seed": 7})))})
