"""Session transcripts: JSON lines with a tool call each, malformed lines passed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file) of every ``*.jsonl`` below a path."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    return d.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def shell_commands(lines: DataFrame, line: str = "line") -> DataFrame:
    """Add ``command`` of lines that call the shell tool; other lines go, malformed ones too."""
    get = lambda path: F.get_json_object(line, path)
    d = lines.filter((get("$.type") == "tool_use") & (get("$.name") == "Bash"))
    return d.withColumn("command", get("$.input.command")).filter("command is not null")


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value) == kind, F.lit(False))


def decode_hooks(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Add ``adapter``, ``command`` and ``session_id`` of hook payloads of three shapes; others go, malformed ones too.

    ``nested`` is a call of the shell tool, ``{tool_name: "Bash", tool_input: {command}, session_id}``, ``args`` gives a tool and its arguments,
    ``{tool, args: [...]}``, which are joined by blanks, and ``plain`` is ``{command}``. Fields of another type than text make a
    payload malformed. Bodies are parsed once, into a variant, so shapes needn't be known before.
    """
    get = lambda path: F.try_variant_get("__v", path, "variant")
    text = lambda path: F.when(_is(get(path), "STRING"), F.try_variant_get("__v", path, "string"))
    d = payloads.select(F.struct("*").alias("__row"), F.try_parse_json(body).alias("__v"))
    session_ok = get("$.session_id").isNull() | F.is_variant_null(get("$.session_id")) | _is(get("$.session_id"), "STRING")
    nested = (text("$.tool_name") == "Bash") & text("$.tool_input.command").isNotNull() & session_ok
    args = text("$.tool").isNotNull() & F.coalesce(F.schema_of_variant(get("$.args")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    adapter = F.when(nested, "nested").when(args, "args").when(text("$.command").isNotNull() & get("$.tool_name").isNull(), "plain")
    command = F.when(F.col("adapter") == "nested", text("$.tool_input.command")).when(F.col("adapter") == "args", F.array_join(F.try_variant_get("__v", "$.args", "array<string>"), " ")).otherwise(text("$.command"))
    d = d.withColumn("adapter", adapter).filter("adapter is not null")
    return d.select(*[F.col("__row")[c].alias(c) for c in payloads.columns], "adapter", command.alias("command"), F.when(F.col("adapter") == "nested", text("$.session_id")).alias("session_id"))


def hook_commands(payloads: DataFrame, body: str = "body") -> DataFrame:
    """Add ``command`` and ``session_id`` of hook payloads for the shell tool."""
    d = payloads.withColumn("__p", F.from_json(body, "tool_name string, tool_input struct<command:string>, session_id string"))
    d = d.filter((F.col("__p.tool_name") == "Bash") & F.col("__p.tool_input.command").isNotNull())
    return d.select(*payloads.columns, F.col("__p.tool_input.command").alias("command"), F.col("__p.session_id").alias("session_id"))
