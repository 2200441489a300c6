"""Reading ticket tables, splits and predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.numeric import coerce_double, round_scaled
from ..operators.columns import require_columns
from ..operators.profile import profile_dataset, select_largest
from .delimited import read_delimited_blocks
from .json_documents import read_json_blocks


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def _missing_to_null(df: DataFrame, cells: Sequence[str]) -> DataFrame:
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        *[F.when(~df[f"`{c}`"].isin(*cells), df[f"`{c}`"]).alias(c) if c in texts else df[f"`{c}`"] for c in df.columns]
    )


def read_tickets(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    format: str | None = None,
    multi_line: bool = True,
    infer: bool = False,
    missing: Sequence[str] = K.MISSING_CELLS,
    parallel: bool = False,
    position: str | None = None,
) -> DataFrame:
    """Read a table by the suffix of its path (csv, tsv, jsonl, json, parquet).

    Message bodies hold line breaks and quotes, so delimited files are read with quoted
    multi-line cells, a file by one task. With `parallel` many tasks read a large file
    (`read_delimited_blocks`); `position` then names a column that orders the rows as in the
    files. Pass `multi_line=False` for files without line breaks in cells. Cells are text unless a schema is given or `infer` is set, and the usual
    missing markers are null. A `.json` file is a document (a list of rows, a row or a value)
    or one row per line; malformed JSON is an error that names the path. With `parallel` a
    `.json` document has to be a list of rows, and many tasks read it (`read_json_blocks`).
    """
    kind = format or _suffix(path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    if parallel and kind == "json" and schema is None and position is None:
        return read_json_blocks(spark, path)
    if parallel and (kind not in ("csv", "tsv") or infer):
        raise ValueError("delimited files without type inference, and JSON lists without a schema, can be read in parallel")
    if parallel:
        return _missing_to_null(read_delimited_blocks(spark, path, "\t" if kind == "tsv" else ",", schema, position), missing)
    if kind in ("csv", "tsv"):
        df = reader.csv(
            path,
            header=True,
            sep="\t" if kind == "tsv" else ",",
            quote='"',
            escape='"',
            multiLine=multi_line,
            inferSchema=infer and schema is None,
        )
        return _missing_to_null(df, missing)
    if kind == "jsonl":
        if schema is not None:
            return reader.json(path, mode="FAILFAST")
        df = reader.json(path)
        if "_corrupt_record" in df.columns:
            raise ValueError(f"malformed JSON lines: {path}")
        return df
    if kind == "json":
        if schema is not None:
            return reader.json(path, multiLine=multi_line, mode="FAILFAST")
        return _read_json(spark, path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported dataset format: {path}")


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    """One value per line (how Spark writes) or one document over several lines; anything else is an error.

    Lines that all parse are read as lines. Otherwise every file must hold one JSON value as
    a whole, which a file of lines with a bad one among them does not.
    """
    df = spark.read.json(path)
    if "_corrupt_record" not in df.columns:
        return df
    whole = spark.read.text(path, wholetext=True)
    options = {"columnNameOfCorruptRecord": "bad"}
    wrapped = F.from_json(F.concat(F.lit('{"value":'), F.col("value"), F.lit("}")), "value string, bad string", options)
    parsed = whole.select(wrapped.alias("r"))
    if not parsed.where(F.col("r").isNull() | F.col("r.bad").isNotNull()).isEmpty():
        raise ValueError(f"malformed JSON: {path}")
    document = spark.read.json(path, multiLine=True)
    if document.columns == ["_corrupt_record"]:  # a bare value
        return parsed.select("r.value")
    return document


def read_splits(spark: SparkSession, paths: Mapping[str, str], **options) -> DataFrame:
    """Union of the split files with a `split` column; columns a file lacks are null."""
    if not paths:
        raise ValueError("no split files")
    result = None
    for name, path in paths.items():
        part = read_tickets(spark, path, **options).withColumn("split", F.lit(name))
        result = part if result is None else result.unionByName(part, allowMissingColumns=True)
    return result


def prepare_predictions(df: DataFrame) -> DataFrame:
    """Check the columns of a prediction table and coerce its numbers.

    An unreadable or missing confidence is 0; the margin of the two best probabilities is
    added (four digits) when only the probabilities are there.
    """
    require_columns(df, ["true_label", "predicted_label", "confidence"])
    shaped = df.withColumn("confidence", coerce_double(df, "confidence"))
    if "top1_top2_margin" not in df.columns and {"top_1_probability", "top_2_probability"} <= set(df.columns):
        gap = coerce_double(df, "top_1_probability") - coerce_double(df, "top_2_probability")
        shaped = shaped.withColumn("top1_top2_margin", round_scaled(gap, 4))
    return shaped


def read_predictions(spark: SparkSession, path: str, **options) -> DataFrame:
    return prepare_predictions(read_tickets(spark, path, **options))


def list_dataset_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, is_smoke_or_generated_output) of the dataset files under a folder, by path.

    Only the listing is read, never a file's content. Generated reports are left out.
    """
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    )
    name = F.element_at(F.split("path", "/"), -1)
    parents = F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1)
    generated = F.arrays_overlap(parents, F.array(*[F.lit(x) for x in K.GENERATED_DIRNAMES]))
    suffix = F.lower(F.substring_index(name, ".", -1))
    return (
        listed.where(F.contains(name, F.lit(".")) & suffix.isin(*K.DATASET_SUFFIXES))
        .where(~name.isin(*K.GENERATED_FILENAMES) & ~F.array_contains(F.split("path", "/"), ".git"))
        .withColumn("is_smoke_or_generated_output", name.isin(*K.SMOKE_FILENAMES) | generated)
        .orderBy("path")
    )


def audit_files(spark: SparkSession, root: str) -> DataFrame:
    """One profile row per dataset file under the folder; an unreadable file has `read_error`.

    Every file has a schema of its own, so each gets its own small plan; the driver holds
    the list of files only.
    """
    rows = None
    for entry in list_dataset_files(spark, root).collect():
        flag = F.lit(entry["is_smoke_or_generated_output"]).alias("is_smoke_or_generated_output")
        try:
            df = read_tickets(spark, entry["path"])
            row = profile_dataset(df, path=entry["path"]).select("*", flag, F.lit(None).cast("string").alias("read_error"))
        except Exception as problem:  # an unreadable file is a finding, not a failure
            message = f"{type(problem).__name__}: {str(problem).splitlines()[0] if str(problem) else ''}"
            row = spark.range(1).select(
                F.lit(entry["path"]).alias("file_path"),
                flag,
                F.lit(False).alias("has_required_training_columns"),
                F.lit(message).alias("read_error"),
            )
        rows = row if rows is None else rows.unionByName(row, allowMissingColumns=True)
    if rows is None:
        raise FileNotFoundError(f"no dataset files under {root}")
    return rows


def resolve_input(
    spark: SparkSession,
    explicit: str | None = None,
    normalized: str | None = None,
    root: str | None = None,
    smoke: str | None = None,
) -> str:
    """Path to read: the explicit one, the normalised file if it exists, the largest real
    dataset under `root`, or the smoke data if allowed (given); otherwise an error."""
    if explicit:
        return explicit
    if normalized and _exists(spark, normalized):
        return normalized
    if root:
        try:
            best = select_largest(audit_files(spark, root)).select("file_path").first()
        except FileNotFoundError:
            best = None
        if best:
            return best[0]
    if smoke:
        return smoke
    raise FileNotFoundError("no real ticket dataset found; add one or allow the smoke data")


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
        return not listed.isEmpty()
    except Exception:
        return False
