"""Files of trials and graphs: reading with fixed schemas, and the line and document formats that are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIAL = "id string, runId string, repetitionId string, repetition int, `order` int, seed long, questionOrder int, conditionOrder int, orderStrategy string, questionId string, condition string, retrieval string, engine string, autoScore string, manualScore string, blind struct<A:string,B:string>, latencyMs double, latencyScope string, prepareMs double, retrievalMs double, generationMs double, contextChars long, evidenceRecall double, evidencePrecision double, retrievedIds array<string>, timestamp long, answer string"
PROVENANCE = "array<struct<sourceId:string,importScopeId:string,sourceKind:string,sourceTitle:string,importedAt:bigint,method:string,confidence:string,evidence:string,page:int,pageEnd:int,section:int,charStart:int,charEnd:int,url:string,pageId:bigint,revisionId:bigint,targetTitle:string,score:double,threshold:double,sharedTerms:array<string>,contentFingerprint:string>>"
NODE = f"id string, title string, type string, community string, aliases array<string>, summary string, custom boolean, provenance {PROVENANCE}"


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trials of a JSON array or of JSON lines; what cannot be parsed gives no row."""
    return spark.read.schema(TRIAL).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON document {nodes, edges}; both empty unless both are arrays."""
    node = f"struct<id:string,title:string,type:string,community:string,aliases:array<string>,summary:string,custom:boolean,provenance:{PROVENANCE}>"
    edge = f"struct<source:string,target:string,relation:string,label:string,custom:boolean,provenance:{PROVENANCE}>"
    doc = spark.read.schema(f"nodes array<{node}>, edges array<{edge}>").option("multiLine", True).json(path).filter("nodes is not null and edges is not null")
    return doc.select(F.inline("nodes")), doc.select(F.inline("edges"))


def normalized_trials(raw: DataFrame, order: str = "ord") -> DataFrame:
    """Trials of older files with what they lack: ids by place (order, from 0), defaults, and generation time from latency."""
    at = F.col(order)
    run, times, scope = F.coalesce("runId", F.lit("legacy_unknown_run")), F.coalesce("repetition", F.lit(1)), F.coalesce("latencyScope", F.lit("generation-only"))
    latency = F.coalesce("latencyMs", F.lit(0.0))
    generation = F.when(scope == "generation-only", latency).otherwise(F.greatest(F.lit(0.0), latency - F.coalesce("prepareMs", F.lit(0.0))))
    return raw.withColumns({
        "id": F.coalesce("id", F.concat(F.lit("legacy_"), at.cast("string"), F.lit("_"), F.coalesce("timestamp", F.lit(0).cast("long")).cast("string"))), "runId": run,
        "repetitionId": F.coalesce("repetitionId", F.concat(run, F.lit("_r"), times.cast("string"))), "repetition": times, "order": F.coalesce(F.col("order"), (at + 1).cast("int")),
        "orderStrategy": F.coalesce("orderStrategy", F.lit("legacy-order-unknown")), "retrieval": F.coalesce("retrieval", F.lit("tfidf")), "latencyMs": latency, "latencyScope": scope, "generationMs": F.coalesce("generationMs", generation),
    })


# The columns of an export, in order.
EXPORTED = "id runId repetitionId repetition order seed questionOrder conditionOrder orderStrategy questionId condition retrieval engine autoScore manualScore blindA blindB latencyMs latencyScope prepareMs retrievalMs generationMs contextChars evidenceRecall evidencePrecision retrievedIds timestamp answer".split()


def csv_lines(trials: DataFrame, order: str = "ord") -> DataFrame:
    """(ord, line) of trials: EXPORTED parted by semicolons, lists by |, whole numbers without a fraction."""

    def shown(c: str) -> Column:
        if c in ("blindA", "blindB"):
            return F.col(f"blind.{c[-1]}")
        if c == "retrievedIds":
            return F.array_join(c, "|")
        if dict(trials.dtypes)[c] == "double":
            return F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
        return F.col(c)

    return trials.select(F.col(order).alias("ord"), csv_line([shown(c) for c in EXPORTED[:-1]], F.col("answer")).alias("line"))


def write_csv(trials: DataFrame, path: str, order: str = "ord") -> None:
    """Text files of csv_lines in order, range-partitioned, so that no task holds all; each begins with the header."""
    lines = csv_lines(trials, order).repartitionByRange("ord").sortWithinPartitions("ord")
    lines.select(F.col("line").alias(";".join(EXPORTED))).write.mode("overwrite").option("header", True).option("quote", "").option("sep", "\u0001").csv(path)


#: Results of a JSON document at most; a power of two, so that no document reaches over partitions.
RESULTS = 4096


def json_documents(trials: DataFrame, by: str = "runId") -> DataFrame:
    """(by, part, document): each run as nested JSON documents of up to RESULTS results by place, with schema version and ordering.

    A run has as many documents as it needs, so none is larger than a task can hold; part rises along the run's order,
    and count is a document's own. Ranges of runs and places are sorted apart, and each is cut into documents.
    """
    rest = [c for c in trials.columns if c not in (by, "order")]
    ranged = trials.repartitionByRange(by, "order", *rest).sortWithinPartitions(by, "order", *rest)
    cut = ranged.withColumn("part", F.shiftright(F.monotonically_increasing_id(), RESULTS.bit_length() - 1))
    results = F.transform(F.array_sort(F.collect_list(F.struct("order", F.struct(*[c for c in trials.columns if c != by]).alias("trial")))), lambda x: x["trial"])
    made = cut.groupBy(by, "part").agg(F.count("*").alias("n"), results.alias("results"))
    order = F.struct(F.lit("order").alias("by"), F.lit("questions and conditions are shuffled by seed").alias("note"))
    return made.select(by, "part", F.to_json(F.struct(F.lit(3).alias("schemaVersion"), F.col(by), F.col("n").alias("count"), order.alias("ordering"), "results")).alias("document"))


def put_newer(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Snapshots (key, updated_at, value) after rows were put: a key's row gives way to one that is as new or newer."""
    every = stored.withColumn("late", F.lit(0)).unionByName(rows.withColumn("late", F.lit(1)))
    return every.groupBy("key").agg(F.max_by(F.struct("updated_at", "value"), F.struct("updated_at", "late")).alias("r")).select("key", "r.*")


def csv_line(columns: list[Column], quoted: Column) -> Column:
    """Columns parted by semicolons, null as nothing; the last is quoted, its quotes doubled and line ends blanks."""
    text = F.regexp_replace(F.replace(F.coalesce(quoted, F.lit("")), F.lit('"'), F.lit('""')), "\n", " ")
    return F.concat_ws(";", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns], F.concat(F.lit('"'), text, F.lit('"')))


def write_snapshot(df: DataFrame, path: str) -> None:
    """df as the only content of a Parquet folder."""
    df.write.mode("overwrite").parquet(path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length) of the files of a folder."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")
