"""Sources and sinks of analyses (S1, S9-S11, S14-S25): everything through Spark's readers and writers.

A store is a folder of tables that are only ever appended to, a folder for each save in each of them. The table ``documents``
is the log: a row for each save and each deletion of a document, numbered by what was there before, not by a clock. What a
reader sees of a document are the rows of the save that its newest log row names, none after a deletion, and narratives
told of that very save. So a failed or repeated write shows nothing half done, and no id becomes part of a path.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statera.functions.tokens import display_name
from statera.operators import changes, checks, figures, rules
from statera.plans.analysis import Analysis
from statera.sources.scratch import settled

#: Limits of the gate for incoming files.
MOST_BYTES, MAGIC, MOST_PAGES = 50 * 1024 * 1024, "%PDF-", 1_000
TABLES = ["figures", "metrics", "changes", "checks", "flags"]
LOG = "document_id string, version long, pass long, deleted boolean, save string, name string, basis string, periods array<int>, analyzed_at timestamp"
INSIGHTS = "document_id string, position int, kind string, text string, cites array<string>, model string, telling long, save string"


def gated_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, document_id (the content's SHA-256; null where it stays unread), gate_error, name of every file.

    Contents of too large files stay unread: the reader gets the limit as a filter. Empty files are not listed: Spark plans
    no task for them.
    """
    files = spark.read.format("binaryFile").load(path)
    name = display_name(F.col("path")).alias("name")
    begin = F.substring("content", 1, len(MAGIC)).cast("string")
    error = F.when(F.coalesce(begin, F.lit("")) != MAGIC, "not a PDF")
    small = files.where(F.col("length") <= MOST_BYTES).select("path", "length", F.sha2("content", 256).alias("document_id"), error.alias("gate_error"), name)
    large = files.where(F.col("length") > MOST_BYTES).select("path", "length", F.lit(None).cast("string").alias("document_id"), F.lit("file too large").alias("gate_error"), name)
    return small.union(large)


def gated_texts(status: DataFrame) -> DataFrame:
    """document_id, gate_error from layout.text_layer's result (n_pages, status): what can't be analysed, and why."""
    error = F.when(F.col("status") == "unreadable", "unreadable PDF").when(F.col("n_pages") > MOST_PAGES, "too many pages").when(F.col("status") == "scanned", "scanned PDF")
    return status.select("document_id", error.alias("gate_error"))


def _there(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _read(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    path = f"{folder}/{name}"
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


def _append(rows: DataFrame, folder: str, name: str, save: str) -> None:
    """Files hold few documents each, so that a reader of one skips the others by their least and greatest ids."""
    rows.withColumn("document_id", F.col("document_id").cast("string")).sortWithinPartitions("document_id").write.parquet(f"{folder}/{name}/save={save}")


def _log(rows: DataFrame, folder: str, save: str | None, deleted: bool) -> None:
    """rows: document_id, version, pass, name, basis, periods."""
    out = rows.select(F.col("document_id").cast("string").alias("document_id"), "version", "pass", F.lit(deleted).alias("deleted"), F.lit(save).cast("string").alias("save"), F.col("name").cast("string").alias("name"), F.col("basis").cast("string").alias("basis"), F.col("periods").cast("array<int>").alias("periods"), F.current_timestamp().alias("analyzed_at"))
    out.write.mode("append").parquet(f"{folder}/documents")


def _newest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest log row of every document, deleted ones included; of two saves that knew nothing of each other the same for all readers."""
    log = _read(spark, folder, "documents", LOG)
    row = F.struct(*[F.col(c) for c in log.columns if c != "document_id"])
    return log.groupBy("document_id").agg(F.max_by(row, F.struct("version", "pass", "deleted", F.coalesce("save", F.lit("")))).alias("l")).select("document_id", "l.*")


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are there now, and the save of each: given to several reads as ``at``, they all see the same."""
    return settled(_newest(spark, folder).where("NOT deleted"), "snapshot")


def _versions(spark: SparkSession, folder: str, ids: DataFrame) -> DataFrame:
    old = _newest(spark, folder).select("document_id", F.col("version").alias("_old"))
    known = ids.withColumn("document_id", F.col("document_id").cast("string")).join(old, "document_id", "left")
    return known.withColumn("version", F.coalesce("_old", F.lit(0)) + 1).withColumn("pass", F.lit(0).cast("long")).drop("_old")


def save(result: Analysis, folder: str, names: DataFrame | None = None, broken: str = "fail") -> None:
    """Append the result frames; a document saved again is replaced, and its narratives go, as soon as its log row is written.

    names: document_id and name of the files they came from, if known. What follows from a document's figures is computed once; each
    frame is then one narrow write, which counts the rows that break the rule that exactly one of value and reason
    is there. With ``broken`` "fail" any such row leaves the whole save unseen; with "quarantine" these rows go to the table of
    that name instead.
    """
    if broken not in ("fail", "quarantine"):
        raise ValueError(f"broken is fail or quarantine, not {broken}")
    spark, name = result.periods.sparkSession, f"s{uuid.uuid4().hex}"
    wide, without = settled(result.wide, "wide"), settled(result.without_periods, "without-periods")
    frames = {
        "figures": figures.figures_long(wide), "metrics": figures.metrics_long(wide), "changes": changes.changes_long(wide), "checks": checks.checks_long(wide),
        "flags": rules.flags(wide).unionByName(rules.without_periods(without)),
    }
    for table, rows in frames.items():
        if table not in ("figures", "metrics"):
            _append(rows, folder, table, name)
            continue
        watched, seen = figures.watched(rows, table)
        _append(watched if broken == "fail" else watched.where(~figures.is_broken()), folder, table, name)
        if count := seen.get["broken"]:
            if broken == "fail":
                raise ValueError(f"{count} rows of {table} have both or neither of value and reason: nothing of this save is seen")
            odd = rows.where(figures.is_broken()).select("document_id", F.lit(table).alias("table"), F.to_json(F.struct("*")).alias("row"))
            odd.withColumn("document_id", F.col("document_id").cast("string")).write.mode("append").parquet(f"{folder}/quarantine/save={name}")
    ids = wide.groupBy("document_id").agg(F.sort_array(F.collect_set("end_year"), asc=False).alias("periods"))
    ids = ids.unionByName(without.select("document_id", F.array().cast("array<int>").alias("periods"))).dropDuplicates(["document_id"])
    basis = None if result.statements is None else result.statements.groupBy("document_id").agg(F.max("basis").alias("basis"))
    ids = ids.withColumn("basis", F.lit(None).cast("string")) if basis is None else ids.join(basis, "document_id", "left")
    ids = ids.withColumn("name", F.lit(None).cast("string")) if names is None else ids.join(names.select("document_id", "name"), "document_id", "left")
    _log(settled(_versions(spark, folder, ids), "log"), folder, name, False)


def load(spark: SparkSession, folder: str, name: str, document_id: str | None = None, at: DataFrame | None = None) -> DataFrame:
    """A saved frame, of one document (only its save's files are read) or of all; ``at`` a snapshot, or as it is now."""
    now = snapshot(spark, folder) if at is None else at
    rows = spark.read.parquet(f"{folder}/{name}")
    if document_id is not None:
        found = now.where(F.col("document_id") == document_id).select("save").collect()
        return rows.where((F.col("save") == (found[0][0] if found else "")) & (F.col("document_id") == document_id)).drop("save")
    return rows.join(now.select("document_id", "save"), ["document_id", "save"], "left_semi").drop("save")


def load_values(spark: SparkSession, folder: str, document_id: str) -> DataFrame:
    """A document's figures by concept and period."""
    return load(spark, folder, "figures", document_id).orderBy("concept", "end_year")


def load_metrics(spark: SparkSession, folder: str, document_id: str) -> DataFrame:
    """A document's ratios by name and period."""
    return load(spark, folder, "metrics", document_id).orderBy("name", "end_year")


def save_narratives(texts: DataFrame, folder: str) -> None:
    """texts: document_id, position (0: summary), kind, text, cites, model. They belong to the documents' present saves, and replace
    what was told of these; a document that isn't there is an error, and nothing is written."""
    spark = texts.sparkSession
    texts = settled(texts.select(F.col("document_id").cast("string").alias("document_id"), "position", "kind", "text", "cites", "model"), "texts")
    now = snapshot(spark, folder).select("document_id", "save")
    if (lost := texts.join(now, "document_id", "left_anti").select("document_id").distinct().count()) > 0:
        raise ValueError(f"{lost} documents of these narratives are not in the store")
    told = _read(spark, folder, "insights", INSIGHTS).groupBy("document_id").agg(F.max("telling").alias("_t"))
    rows = texts.join(now, "document_id").join(told, "document_id", "left").withColumn("telling", F.coalesce("_t", F.lit(0)) + 1)
    settled(rows.select(*[f.split()[0] for f in INSIGHTS.split(", ")]), "told").write.mode("append").partitionBy("save").parquet(f"{folder}/insights")


def _told(spark: SparkSession, folder: str, at: DataFrame) -> DataFrame:
    """Rows of the newest narrative told of each document's save."""
    rows = _read(spark, folder, "insights", INSIGHTS).join(at.select("document_id", "save"), ["document_id", "save"], "left_semi")
    return rows.join(rows.groupBy("document_id").agg(F.max("telling").alias("telling")), ["document_id", "telling"], "left_semi")


def load_narratives(spark: SparkSession, folder: str, at: DataFrame | None = None) -> DataFrame:
    """document_id, summary, insights (text, cites; in order), model of the newest narrative of each document's present save."""
    rows = _told(spark, folder, snapshot(spark, folder) if at is None else at)
    others = F.array_sort(F.collect_list(F.when(F.col("position") > 0, F.struct("position", "text", "cites"))))
    out = rows.groupBy("document_id").agg(F.max(F.when(F.col("position") == 0, F.col("text"))).alias("summary"), others.alias("_i"), F.max("model").alias("model"))
    return out.select("document_id", F.coalesce("summary", F.lit("")).alias("summary"), F.transform("_i", lambda x: F.struct(x["text"].alias("text"), x["cites"].alias("cites"))).alias("insights"), "model")


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, name, basis, periods, analyzed_at of the documents that are there, newest first."""
    return snapshot(spark, folder).select("document_id", "name", "basis", "periods", "analyzed_at").orderBy(F.desc("analyzed_at"), "document_id")


def delete(spark: SparkSession, folder: str, document_id: str) -> None:
    """Hide a document's rows in every frame, its narratives too, whatever its id is made of."""
    ids = spark.range(1).select(F.lit(document_id).alias("document_id"), *[F.lit(None).alias(c) for c in ("name", "basis", "periods")])
    _log(settled(_versions(spark, folder, ids), "log"), folder, None, True)


def compact(spark: SparkSession, folder: str) -> None:
    """Write what is there as one save and drop the files of the saves before it.

    The rows of a document saved meanwhile stay as they are: its newer version goes before the compacted one. Saves that
    were never logged are left alone. Readers that began with an earlier snapshot should be done.
    """
    before, now, name = settled(_read(spark, folder, "documents", LOG), "before"), snapshot(spark, folder), f"s{uuid.uuid4().hex}"
    for table in TABLES:
        if _there(spark, f"{folder}/{table}"):
            _append(load(spark, folder, table, at=now), folder, table, name)
    told = _told(spark, folder, now)
    if _there(spark, f"{folder}/insights"):
        _append(told.drop("save"), folder, "insights", name)
    _log(now.select("document_id", "version", (F.col("pass") + 1).alias("pass"), "name", "basis", "periods"), folder, name, False)
    used = _newest(spark, folder).where("NOT deleted").select("save")
    for (old,) in before.where("save IS NOT NULL").select("save").distinct().join(used, "save", "left_anti").toLocalIterator():
        for table in [*TABLES, "insights"]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/save={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def save_side(rows: DataFrame, path: str) -> None:
    """A small JSON side file (locks, exposed companies, reports), one object a line, replaced as a whole."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def load_side(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def tickers(spark: SparkSession, path: str) -> DataFrame:
    """ticker, cik (ten digits) from a company list: a JSON object of records with ticker and cik_str."""
    rows = spark.read.option("wholetext", True).text(path)
    records = F.explode(F.map_values(F.from_json("value", "map<string,struct<cik_str:long,ticker:string>>")))
    return rows.select(records.alias("r")).select(F.upper("r.ticker").alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"))


def annual_filings(spark: SparkSession, path: str) -> DataFrame:
    """accession, form, filed, report_date, document of annual filings, newest first, from columnar filing lists."""
    names = ["accessionNumber", "form", "filingDate", "reportDate", "primaryDocument"]
    columns = "struct<" + ",".join(f"{n}:array<string>" for n in names) + ">"
    rows = spark.read.schema(f"filings struct<recent:{columns}>, {', '.join(f'{n} array<string>' for n in names)}").json(path, multiLine=True)
    old, new = F.arrays_zip(*names), F.arrays_zip(*[F.col(f"filings.recent.{n}").alias(n) for n in names])
    every = rows.select(F.inline(F.coalesce(new, old)).alias("accession", "form", "filed", "report_date", "document"))
    return every.where("form = '10-K'").withColumn("filed", F.to_date("filed")).orderBy(F.desc("filed"))


def truth_facts(spark: SparkSession, path: str, tags: DataFrame) -> DataFrame:
    """Facts in USD from companyfacts files for the tags (tag, concept, kind): concept, tag, kind, start, end, accession, value, fy."""
    unit = "array<struct<start:date,end:date,val:decimal(38,4),accn:string,fy:int,fp:string,form:string,filed:date>>"
    rows = spark.read.schema(f"facts struct<`us-gaap`:map<string,struct<units:map<string,{unit}>>>>").json(path, multiLine=True)
    each = rows.select(F.explode(F.col("facts.us-gaap")).alias("tag", "t")).select("tag", F.explode(F.try_element_at("t.units", F.lit("USD"))).alias("f"))
    return each.join(F.broadcast(tags), "tag").select("concept", "tag", "kind", "f.start", "f.end", F.col("f.accn").alias("accession"), F.col("f.val").alias("value"), "f.fy")


def save_truth(known: DataFrame, path: str) -> None:
    """Freeze true values (document_id, concept, end_year, values, tags) as JSON lines; values as text, so none is rounded."""
    known.withColumn("values", F.transform("values", lambda v: v.cast("string"))).write.mode("overwrite").json(path)


def load_truth(spark: SparkSession, path: str, offsets: DataFrame | None = None) -> DataFrame:
    """Frozen true values; offsets (document_id, fiscal_year_offset) move a company's years to those its statements print."""
    rows = spark.read.schema("document_id string, concept string, end_year int, values array<string>, tags array<string>").json(path)
    rows = rows.withColumn("values", F.col("values").cast("array<decimal(38,4)>"))
    if offsets is None:
        return rows
    moved = rows.join(offsets.select("document_id", "fiscal_year_offset"), "document_id", "left")
    return moved.withColumn("end_year", F.col("end_year") + F.coalesce("fiscal_year_offset", F.lit(0))).select(rows.columns)


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Companies to evaluate, from CSV; an offset is blank, 0 or -1 and one that isn't blank needs evidence, or the
    whole list is an error."""
    rows = spark.read.schema("ticker string, bucket string, sector string, local_pdf string, fiscal_year_offset string, offset_evidence string").option("header", True).csv(path)
    offset = F.coalesce("fiscal_year_offset", F.lit(""))
    bad = ~offset.isin("", "0", "-1") | ((offset != "") & (F.coalesce(F.trim("offset_evidence"), F.lit("")) == ""))
    if odd := [r[0] for r in rows.where(bad).select("ticker").limit(10).collect()]:
        raise ValueError(f"bad fiscal_year_offset for {', '.join(map(str, odd))}")
    return rows.withColumn("fiscal_year_offset", F.coalesce(offset.try_cast("int"), F.lit(0)))


def snapshot_lines(result: Analysis) -> DataFrame:
    """One sorted line for each fact: document | kind | key | payload."""
    line = lambda kind, key, payload: F.concat_ws(" | ", F.col("document_id"), F.lit(kind), key, payload).alias("line")
    at = lambda name: F.concat_ws("@", F.col(name), F.col("end_year"))
    there = F.col("value").isNotNull()
    reason = F.concat(F.col("na.root_reason"), F.lit(": "), F.col("na.root_detail"))
    parts = [
        result.figures.where(there).select(line("value", at("concept"), F.concat_ws(" ", F.col("value").cast("string"), "currency"))),
        result.metrics.where(there).select(line("metric", at("name"), F.concat_ws(" ", F.col("value").cast("string"), "unit"))),
        result.metrics.where(~there).select(line("metric_unavailable", at("name"), reason)),
        result.checks.select(line("recon", at("name"), F.concat_ws(" ", "status", F.coalesce(F.col("delta").cast("string"), F.lit("UNAVAILABLE"))))),
        result.flags.select(line("flag", F.col("rule_id"), F.concat_ws(" ", "outcome", "severity"))),
        result.changes.where("na IS NULL").select(line("trend", F.concat(F.col("subject"), F.lit("@"), F.col("from_year"), F.lit("->"), F.col("to_year")), F.concat_ws(" ", F.col("absolute").cast("string"), "direction", "economic"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.orderBy("line")
