"""Change feeds: read, parse the envelope, write to and restore from flat text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillflow.functions.columns import computed
from quillflow.sources.catalog import OPERATIONS

CORRUPT = "_corrupt_record"

# Files of one micro-batch of a streaming read; bounds the state work of one batch.
FILES_PER_BATCH = 1000


def envelope_schema(document: T.DataType, id_type: T.DataType | None = None) -> T.StructType:
    """Schema of one raw change record whose documents have type ``document``."""
    return T.StructType([
        T.StructField("_id", T.StringType()),
        T.StructField("operationType", T.StringType()),
        T.StructField("ns", T.StructType([
            T.StructField("db", T.StringType()), T.StructField("coll", T.StringType())])),
        T.StructField("documentKey", T.StructType([
            T.StructField("_id", id_type or T.StringType())])),
        T.StructField("fullDocument", document),
        T.StructField("updateDescription", T.VariantType()),
        T.StructField("clusterTime", T.TimestampType()),
    ])


def read_changes(
    spark: SparkSession,
    path: str | None,
    schema: T.StructType | None,
    fmt: str = "json",
    streaming: bool = False,
    **options: str,
) -> DataFrame:
    """A feed folder as a batch or streaming frame.

    Each namespace has its own folder or glob; the position in it is the query's checkpoint. A
    streaming read takes ``FILES_PER_BATCH`` files at a time unless told otherwise. A feed of a
    message queue (``fmt="kafka"``) has no path and no schema; its ``value`` goes through
    ``split_unreadable``.
    """
    if fmt == "kafka":
        source = (spark.readStream if streaming else spark.read).format(fmt).options(**options)
        return source.load().withColumn("value", F.col("value").cast("string"))
    if not streaming:
        return spark.read.format(fmt).schema(schema).options(**options).load(path)
    options.setdefault("maxFilesPerTrigger", str(FILES_PER_BATCH))
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def split_unreadable(lines: DataFrame, schema: T.StructType, text: str = "value") -> DataFrame:
    """Parse text records; an unreadable one keeps its text and an error (never fails the job).

    The result has ``record`` (NULL when unreadable), ``raw`` and ``error``. Both halves come
    from one pass, so a caller filters on ``error`` for the side output.
    """
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(
        F.col(text), marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    kept = [c for c in lines.columns if c != text]
    frame = lines.select(*kept, F.col(text).alias("raw"), computed(parsed).alias("_parsed"))
    bad = F.col("_parsed").isNull() | F.col(f"_parsed.{CORRUPT}").isNotNull()
    record = F.struct(*[F.col(f"_parsed.`{f.name}`").alias(f.name) for f in schema.fields])
    return frame.select(
        *kept,
        F.when(~bad, record).alias("record"),
        "raw",
        F.when(bad, F.lit("Failed to deserialize")).alias("error"),
    )


def id_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a document id; a missing, empty, zero or false id is the empty string."""
    text = value.cast("string")
    if isinstance(dtype, T.NumericType):
        text = F.when(value != 0, text)
    elif isinstance(dtype, T.BooleanType):
        text = F.when(value, F.lit("True"))
    return F.coalesce(text, F.lit(""))


def parse_changes(raw: DataFrame) -> DataFrame:
    """Raw envelopes as change events: an unknown operation counts as an update."""
    id_type = raw.schema["documentKey"].dataType["_id"].dataType
    known = F.col("operationType").isin(*OPERATIONS)
    used = {"_id", "operationType", "ns", "documentKey", "fullDocument", "updateDescription",
            "clusterTime"}
    extra = [c for c in raw.columns if c not in used]
    optional = [
        (F.col(source) if source in raw.columns else F.lit(None).cast(kind)).alias(name)
        for source, name, kind in (
            ("updateDescription", "update_description", "variant"),
            ("_id", "resume_token", "string"),
            ("clusterTime", "cluster_time", "timestamp"))
    ]
    return raw.select(
        *extra,
        F.when(known, F.col("operationType")).otherwise("update").alias("operation"),
        F.col("ns.db").alias("database"),
        F.col("ns.coll").alias("collection"),
        F.concat_ws(".", "ns.db", "ns.coll").alias("namespace"),
        id_text(F.col("documentKey._id"), id_type).alias("document_id"),
        F.col("fullDocument").alias("full_document"),
        *optional,
    )


_TIME_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "ignoreNullFields": "false"}


def serialize_events(events: DataFrame, column: str = "data") -> DataFrame:
    """All columns as one JSON text per event; ids and times become text."""
    return events.select(F.to_json(F.struct("*"), _TIME_FORMAT).alias(column))


def restore_events(lines: DataFrame, schema: T.StructType, column: str = "data") -> DataFrame:
    """Inverse of ``serialize_events``."""
    parsed = F.from_json(F.col(column), schema, {"timestampFormat": _TIME_FORMAT["timestampFormat"]})
    return lines.select(parsed.alias("_e")).select("_e.*")
