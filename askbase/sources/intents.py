"""Intents documents and flat QA records.

Three layouts:

* ``lines``: one intent per JSON line, with its ``intent_pos``.  Any number
  of files per directory; this is the layout that scales.
* ``documents``: one ``{"offset": n, "intents": [...]}`` document per line,
  each holding a bounded chunk of consecutive intents; ``offset`` is the
  position of its first intent, so order survives any file layout.
* ``document``: the reference's ``{"intents": [...]}`` document, indented or
  not.  Written as one such file per chunk of consecutive intents, with names
  that sort in that order (a knowledge base of one chunk is one file).

QA records likewise: ``lines`` with their positions, or ``array``, the reference's
file with one indented array of records.  A file that holds no such document or
record fails; it is never read as null rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from askbase import schemas

INTENT_FIELDS = ["tag", "patterns", "responses", "context_set"]
LINE_SCHEMA = T.StructType([T.StructField("intent_pos", T.IntegerType())] + schemas.INTENT.fields)
CHUNK_SCHEMA = T.StructType([T.StructField("offset", T.LongType())] + schemas.INTENTS_DOC.fields)
CHUNK_INTENTS = 10_000   # intents per document in the ``documents`` layout


def read_intents(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """One row per intent: ``intent_pos, tag, patterns, responses, context_set``.

    Document layout over several files: positions continue across files in
    file-name order (a rank over the distinct file names, one row per file).
    """
    if layout == "lines":
        return spark.read.schema(LINE_SCHEMA).json(path)
    if layout == "split":        # the document layout, however large a file: many tasks read it
        from askbase.sources.split_document import read_intents_document
        return read_intents_document(spark, path)
    if layout == "documents":
        d = spark.read.schema(CHUNK_SCHEMA).json(path)
        x = d.select("offset", F.posexplode("intents").alias("_pos", "i"))
        return x.select((F.col("offset") + F.col("_pos")).cast("int").alias("intent_pos"),
                        *[F.col("i")[f].alias(f) for f in INTENT_FIELDS])
    docs = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    docs = docs.select(F.input_file_name().alias("_file"), F.from_json("value", schemas.INTENTS_DOC)["intents"].alias("intents"))
    docs = docs.withColumn("intents", F.coalesce("intents", F.raise_error(F.lit("a file holds no intents document"))))
    x = docs.select("_file", F.posexplode("intents").alias("_pos", "i"))
    sizes = docs.groupBy("_file").agg(F.sum(F.size("intents")).alias("_n"))
    from pyspark.sql import Window
    off = sizes.select("_file", F.coalesce(F.sum("_n").over(
        Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return (x.join(off, "_file")
            .select((F.col("_off") + F.col("_pos")).cast("int").alias("intent_pos"),
                    *[F.col("i")[f].alias(f) for f in INTENT_FIELDS]))


def _one_file_each(docs: DataFrame, path: str) -> DataFrame:
    """Write each ``value`` as a file; file names sort in the order of ``part``."""
    docs.repartitionByRange("part").sortWithinPartitions("part").select("value").write.mode("overwrite").option(
        "maxRecordsPerFile", 1).text(path)
    return docs


def write_intents(intents: DataFrame, path: str, layout: str = "lines") -> None:
    """Write intents as UTF-8 JSON (non-ASCII kept as is)."""
    if layout == "lines":
        intents.select("intent_pos", *INTENT_FIELDS).write.mode("overwrite").json(path)
        return
    if layout == "documents":
        chunk = F.floor(F.col("intent_pos") / F.lit(CHUNK_INTENTS))
        g = intents.groupBy(chunk.alias("_c")).agg(
            F.sort_array(F.collect_list(F.struct("intent_pos", *INTENT_FIELDS))).alias("a"))
        g.select(F.to_json(F.struct(
            F.col("a")[0]["intent_pos"].cast("long").alias("offset"),
            F.transform("a", lambda s: F.struct(*[s[f].alias(f) for f in INTENT_FIELDS])).alias("intents")))
            .alias("value")).write.mode("overwrite").text(path)
        return
    part = F.lpad(F.floor(F.col("intent_pos") / F.lit(CHUNK_INTENTS)).cast("string"), 10, "0")
    g = intents.groupBy(part.alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("intent_pos", *INTENT_FIELDS))).alias("a"))
    g.select("part", F.to_json(F.struct(
        F.transform("a", lambda s: F.struct(*[s[f].alias(f) for f in INTENT_FIELDS])).alias("intents")),
        {"pretty": "true"}).alias("value")).transform(_one_file_each, path)


def write_qa_records(qa: DataFrame, path: str, layout: str = "lines") -> None:
    """Flat QA rows as JSON records (with positions, so order survives), or as
    files of one indented array each, an intent's rows in order (``array``)."""
    if layout == "lines":
        qa.write.mode("overwrite").json(path)
        return
    rows = F.sort_array(F.collect_list(F.struct("pattern_pos", "response_pos", *schemas.QA.names)))
    g = qa.groupBy(F.lpad(F.col("intent_pos").cast("string"), 10, "0").alias("part")).agg(rows.alias("a"))
    g.select("part", F.to_json(F.transform("a", lambda s: F.struct(*[s[f].alias(f) for f in schemas.QA.names])),
                               {"pretty": "true"}).alias("value")).transform(_one_file_each, path)


QA_RECORD_SCHEMA = schemas.QA_POS


def read_qa_records(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """S3: read the records back with an explicit schema (lossless round trip).

    ``array``: files of one array of ``Pattern, Tag, Response`` records; adds ``file``
    and ``record_pos``, the place in the file's array.  A record with none of
    the three, or a file without an array, fails.
    """
    if layout == "lines":
        rows, names = spark.read.schema(QA_RECORD_SCHEMA).json(path), QA_RECORD_SCHEMA.names
    else:
        files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(
            F.input_file_name().alias("file"), F.from_json("value", T.ArrayType(schemas.QA)).alias("a"))
        files = files.withColumn("a", F.coalesce("a", F.raise_error(F.lit("a file holds no array of QA records"))))
        rows = files.select("file", F.posexplode("a").alias("record_pos", "r")).select("file", "record_pos", "r.*")
        names = rows.columns
    bad = F.coalesce(*schemas.QA.names).isNull()
    return rows.select(F.when(bad, F.raise_error(F.lit("a line or array element is no QA record"))).otherwise(
        F.col("Pattern")).alias("Pattern"), *[n for n in names if n != "Pattern"]).select(*names)


def empty_qa(spark: SparkSession) -> DataFrame:
    """An empty table with the fixed QA columns."""
    return spark.createDataFrame([], schemas.QA)
