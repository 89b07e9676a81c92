"""JSON-lines readers with explicit schemas.

An example is identified by its place in the input, never by its question:
``example_id`` is the file's path and the number of its line, so it survives
unions of reads and doesn't depend on how files are split.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gradeframe.functions.text import NON_SPACE, SPACE, strip

# Known benchmarks and their files.
MATH_BENCHMARKS = {
    "aime24": "data/aime24.jsonl",
    "aime25": "data/aime25.jsonl",
    "math500": "data/math500.jsonl",
    "olympiadbench": "data/olympiadbench.jsonl",
}
CHOICE_BENCHMARKS = {"csqa": "data/commonsenseqa.jsonl"}

MATH_SCHEMA = "question string, answer string"
CHOICE_SCHEMA = ("id string, question string, question_concept string, "
                 "choices struct<label: array<string>, text: array<string>>, answerKey string")
RAW_SCHEMA = "question string, answer string, outputs array<string>"
CHOICE_RESULT_SCHEMA = CHOICE_SCHEMA + ", outputs array<string>, predicted_answers array<string>"


_PATH, _FILE, _BLOCK, _ROW = "__path", "__file", "__block", "__row"
SPLITS_SENT = 4_000_000  # rows of the split table, 24 bytes each, up to which every task gets it


def _split_table(lines: DataFrame) -> DataFrame:
    """First row number of each split of the scan, and the lines of the file before it.

    Counted while this is called, once, whatever is done with the lines later.
    It comes to the driver as file hash, block and two numbers; the number of
    splits follows from the size of the input and is checked.
    """
    earlier = Window.partitionBy(_PATH).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    splits = (lines.groupBy(_PATH, _BLOCK).agg(F.count(F.lit(1)).alias("__lines"), F.min(_ROW).alias("__first"))
              .select(F.xxhash64(_PATH).alias(_FILE), _BLOCK,
                      (F.coalesce(F.sum("__lines").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")))
    found = splits.limit(SPLITS_SENT + 1).toArrow()
    if found.num_rows > SPLITS_SENT:
        return splits
    if found.group_by([_FILE, _BLOCK]).aggregate([]).num_rows < found.num_rows:
        raise RuntimeError("two files have one hash; read them apart")
    return F.broadcast(lines.sparkSession.createDataFrame(found, splits.schema))


def numbered_lines(spark: SparkSession, path: str | Sequence[str],
                   glob: str | None = None) -> DataFrame:
    """Lines of text files as ``value`` with ``example_id`` and ``file_name``.

    A line's number is its place in its split plus the lines of the file's
    earlier splits, which one pass over the files counts when this is called.
    The counts, one row per split, go to where the lines are, so texts don't
    move. Numbers are padded, so ids of a file sort like its lines. Files that
    changed since they were counted fail.
    """
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    lines = reader.text(path).select(
        "value", F.col("_metadata.file_path").alias(_PATH), F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias(_BLOCK), F.monotonically_increasing_id().alias(_ROW))
    # A row's number counts from its task's first row, in this scan as in the one that counted.
    known = lines.withColumn(_FILE, F.xxhash64(_PATH)).join(_split_table(lines), [_FILE, _BLOCK], "left")
    changed = F.raise_error(F.concat(F.lit("split not counted: "), F.col(_PATH))).cast("long")
    number = F.col(_ROW) + F.coalesce("__shift", changed)
    return known.select(
        "value", "file_name", F.format_string("%s:%012d", F.col(_PATH), number).alias("example_id"))


def _read(spark: SparkSession, path: str | Sequence[str], schema: str,
          glob: str | None = None) -> DataFrame:
    """Records of JSON lines; blank lines are skipped and malformed ones fail."""
    lines = numbered_lines(spark, path, glob)
    filled = F.rlike("value", F.lit(NON_SPACE))
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return (lines.where(filled).withColumn("__record", F.when(filled, record))
            .select("__record.*", "example_id", "file_name"))


def missing_fields(required: Iterable[str]) -> Column:
    """Names of the required fields a row lacks."""
    return F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) for c in required]))


def require(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Fail on the first row without a required field."""
    lacking = missing_fields(required)
    message = F.concat(F.lit("missing field: "), F.array_join(lacking, ", "))
    return df.where(F.when(F.size(lacking) > 0, F.raise_error(message).cast("boolean"))
                    .otherwise(F.lit(True)))


def rejects(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that ``require`` would fail on, with the names of the missing fields."""
    return df.withColumn("missing", missing_fields(required)).where(F.size("missing") > 0)


def checked(lines: DataFrame, schema: str, required: Sequence[str], value: str = "value") -> DataFrame:
    """Records of JSON lines, good and bad, from one pass; no line fails the job.

    Adds the fields of ``schema`` and ``rejected``: NULL for a good record,
    otherwise the reason and the line as it stands. A line that isn't one JSON
    object of these types is malformed and has no fields; one that lacks a
    required field names all that it lacks. Blank lines are skipped.
    """
    text = F.col(value)
    filled = F.rlike(text, F.lit(NON_SPACE))
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    record = F.from_json(strip(text), f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad"})
    sound = F.coalesce(F.rlike(text, F.lit(rf"^{SPACE}*+\{{")) & F.col("__record").isNotNull()
                       & F.col("__record.__bad").isNull(), F.lit(False))
    fields = {n: F.when(F.col("__sound"), F.col(f"__record.{n}")) for n in names}
    lacking = F.array_join(missing_fields(required), ", ")
    reason = F.when(~F.col("__sound"), F.lit("malformed")).when(lacking != "", F.concat(F.lit("missing field: "), lacking))
    return (lines.where(filled).withColumn("__record", F.when(filled, record)).withColumn("__sound", sound)
            .withColumns(fields).withColumn("__reason", reason)
            .withColumn("rejected", F.when(F.col("__reason").isNotNull(),
                                           F.struct(F.col("__reason").alias("reason"), text.alias("line"))))
            .drop("__record", "__sound", "__reason", value))


def read_checked(spark: SparkSession, path: str | Sequence[str], schema: str, required: Sequence[str],
                 glob: str | None = None) -> DataFrame:
    """``checked`` records of files, with ``example_id`` and ``file_name`` for good and bad ones alike.

    ``sinks.write_checked`` parts them while they are written.
    """
    return checked(numbered_lines(spark, path, glob), schema, required)


def accepted(records: DataFrame) -> DataFrame:
    """The good records of ``checked``."""
    return records.where("rejected IS NULL").drop("rejected")


def rejected(records: DataFrame, *keys: str) -> DataFrame:
    """The reject table of ``checked``: where each bad line stands, why it is bad, and the line."""
    return records.where("rejected IS NOT NULL").select(
        *(keys or ("example_id", "file_name")), "rejected.reason", "rejected.line")


def _known(name: str, paths: Mapping[str, str]) -> str:
    if name not in paths:
        raise ValueError(f"unknown benchmark: {name}, expected one of {list(paths)}")
    return paths[name]


def read_math_benchmark(spark: SparkSession, name: str,
                        paths: Mapping[str, str] = MATH_BENCHMARKS) -> DataFrame:
    df = _read(spark, _known(name, paths), MATH_SCHEMA).drop("file_name").withColumn(
        "benchmark", F.lit(name))
    return require(df, ["question", "answer"])


def read_choice_benchmark(spark: SparkSession, name: str,
                          paths: Mapping[str, str] = CHOICE_BENCHMARKS,
                          allow_null_key: bool = False) -> DataFrame:
    """Choice items; a NULL answer key is an error unless allowed."""
    df = _read(spark, _known(name, paths), CHOICE_SCHEMA).drop("file_name").withColumn(
        "benchmark", F.lit(name))
    return require(df, ["question", "choices"] + ([] if allow_null_key else ["answerKey"]))


def read_raw_generations(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return require(_read(spark, path, RAW_SCHEMA), ["question", "answer", "outputs"]).drop("file_name")


def _named(name: str, suffix: str) -> Column:
    return F.regexp_extract(name, f"^(.*){suffix}$", 1)


def read_raw_folder(spark: SparkSession, folder: str,
                    names: Sequence[str] = tuple(MATH_BENCHMARKS)) -> DataFrame:
    """Raw generations of a run folder, ``<benchmark>_raw.jsonl`` each, in one table.

    ``benchmark`` comes from the file name; files of other names are left alone.
    """
    files = "{" + ",".join(f"{n}_raw.jsonl" for n in names) + "}"
    df = require(_read(spark, folder, RAW_SCHEMA, files), ["question", "answer", "outputs"])
    return df.withColumn("benchmark", _named("file_name", r"_raw\.jsonl")).drop("file_name")


def read_answer_folder(spark: SparkSession, folder: str,
                       names: Sequence[str] = tuple(MATH_BENCHMARKS)) -> DataFrame:
    """Extracted answers of a run folder, ``<benchmark>.jsonl`` each, in one table."""
    files = "{" + ",".join(f"{n}.jsonl" for n in names) + "}"
    lines = parse_answers(numbered_lines(spark, folder, files))
    return lines.withColumn("benchmark", _named("file_name", r"\.jsonl")).drop("file_name")


def read_choice_results(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return _read(spark, path, CHOICE_RESULT_SCHEMA).drop("file_name")


def read_answers(spark: SparkSession, path: str | Sequence[str],
                 arrays_only: bool = False) -> DataFrame:
    """Extracted answers, whatever shape their fields have.

    ``arrays_only`` is the quick way for files known to hold nothing but arrays.
    """
    if arrays_only:
        return _read(spark, path, "answer string, predicted_answers array<string>").drop("file_name")
    return parse_answers(numbered_lines(spark, path).drop("file_name"))


def parse_answers(lines: DataFrame, value: str = "value") -> DataFrame:
    """Tolerant reading of answer lines.

    Blank lines are skipped; a missing answer is '' and a missing list is empty;
    a scalar counts as a list of one, and so does a JSON null. Numbers keep the
    text they were written with.
    """
    filled = F.rlike(F.col(value), F.lit(NON_SPACE))
    # One parse settles lines that hold a list. Only the others are looked at again.
    listed = F.from_json(F.col(value), "answer string, predicted_answers array<string>, __bad string",
                         {"columnNameOfCorruptRecord": "__bad"})
    plain = F.coalesce(F.col("__listed.predicted_answers").isNotNull() & F.col("__listed.answer").isNotNull()
                       & F.col("__listed.__bad").isNull(), F.lit(False))
    raw = F.when(~plain, F.from_json(F.col(value), "answer string, predicted_answers string"))
    variant = F.when(~plain, F.parse_json(value))
    field = F.variant_get("__variant", "$.predicted_answers", "variant")
    kind = (F.when(F.col("__field").isNull(), F.lit("missing"))
            .when(F.is_variant_null("__field"), F.lit("null"))
            .when(F.startswith(F.schema_of_variant("__field"), F.lit("ARRAY")), F.lit("array"))
            .otherwise(F.lit("scalar")))
    no_answer = F.variant_get("__variant", "$.answer", "variant").isNull()
    one = F.array(F.col("__raw.predicted_answers"))
    predicted = (F.when(plain | (F.col("__kind") == "array"), F.col("__listed.predicted_answers"))
                 .when(F.col("__kind") == "missing", F.array().cast("array<string>"))
                 .when(F.col("__kind") == "null", F.array(F.lit(None).cast("string")))
                 .otherwise(one))
    answer = (F.when(plain, F.col("__listed.answer")).when(no_answer, F.lit(""))
              .otherwise(F.col("__raw.answer")))
    # Guarded twice: a filter does not promise to be tested before the parser runs.
    return (lines.where(filled)
            .withColumn("__listed", F.when(filled, listed))
            .withColumn("__variant", F.when(filled, variant))
            .withColumn("__field", field)
            .withColumn("__kind", kind).withColumn("__raw", raw)
            .withColumn("answer", answer)
            .withColumn("predicted_answers", predicted)
            .drop("__listed", "__variant", "__field", "__kind", "__raw", value))
