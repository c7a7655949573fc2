"""Readers for transcript, subtitle, rule, clip, log and report files.

Schemas are explicit; malformed pieces are dropped by predicate. Line-oriented
formats are read in splits, so one huge file is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.functions.text import strip
from cueline.functions.timecode import parse_ass_time, parse_srt_time
from cueline.operators.ordered import dense_position, running_max, running_total
from cueline.session import materialise


def file_id(path: Column) -> Column:
    """File name without directory and extension."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def _field(item: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(item, f"$.{name}", kind)


def _is_number(item: Column, name: str) -> Column:
    """True for a JSON number; NULL where the field is absent."""
    return F.schema_of_variant(F.try_variant_get(item, f"$.{name}", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _first_present(item: Column, names: tuple[str, ...], make) -> Column:
    present = lambda n: F.try_variant_get(item, f"$.{n}", "variant").isNotNull()
    value = F.when(present(names[0]), make(names[0]))
    for n in names[1:]:
        value = value.when(present(n), make(n))
    return value


def read_transcripts(spark: SparkSession, path: str, recursive: bool = False, packed: bool = False) -> DataFrame:
    """Recogniser output, one JSON document per transcript, in either shape.

    An object has ``segments`` with times in seconds; segments without numeric
    times or text are dropped. A bare array has segments whose times are
    seconds below 100000 and milliseconds from there on, tested per field;
    empty text is kept as ''. ``begin`` and ``sentence`` are accepted for
    ``start`` and ``text``.

    ``packed``: files hold many documents, one per line after its name and a tab
    (:func:`cueline.sources.writers.write_packed`), so that the number of files
    does not grow with the number of transcripts. The name is the source file.
    """
    reader = spark.read.option("recursiveFileLookup", recursive).option("wholetext", not packed).text(path)
    name = F.col("_metadata.file_path")
    if packed:
        name = F.substring_index("value", "\t", 1)
        reader = reader.select(name.alias("name"), F.substr("value", F.length(name) + 2).alias("value"))
        name = F.col("name")
    # Each segment is a variant of its own: one for the document would be NULL above a size limit.
    bare = F.col("value").rlike(r"^\s*\[")
    parsed = F.from_json("value", "struct<duration:variant,segments:array<variant>>")
    docs = reader.select(
        file_id(name).alias("transcript_id"),
        name.alias("source_file"),
        bare.alias("bare"),
        F.when(~bare, parsed).alias("doc"),
        F.when(bare, F.from_json("value", "array<variant>")).alias("in_array"),
    )
    items = docs.select(
        "transcript_id", "source_file", F.try_variant_get("doc.duration", "$", "double").alias("duration_s"), "bare",
        F.posexplode(F.coalesce("doc.segments", "in_array")).alias("item_no", "item"),
    )
    item = F.col("item")
    number = lambda n: F.when(_is_number(item, n), _field(item, n, "double"))
    string = lambda n: _field(item, n, "string")
    start = _first_present(item, ("start", "begin"), number).otherwise(F.lit(0.0))
    end = _first_present(item, ("end",), number).otherwise(F.lit(0.0))
    text = _first_present(item, ("text", "sentence"), string).otherwise(F.lit(""))
    ms = lambda t: F.when(F.col("bare") & (t >= 100000), t).otherwise(t * 1000).cast("long")
    rows = items.select("transcript_id", "source_file", "duration_s", "item_no", "bare", start.alias("_s"), end.alias("_e"), F.coalesce(text, F.lit("")).alias("_t"))
    kept = rows.where(F.col("_s").isNotNull() & F.col("_e").isNotNull() & (F.col("bare") | (F.col("_t") != "")))
    kept = kept.withColumn("_range", F.floor(F.col("item_no") / 50_000))
    numbered = dense_position(kept, ["source_file"], ["_range"], ["item_no"], "seg_idx")
    return numbered.select(
        "transcript_id", "seg_idx", ms(F.col("_s")).alias("start_ms"), ms(F.col("_e")).alias("end_ms"),
        strip(F.col("_t")).alias("text"), "source_file", "duration_s",
    )


CANONICAL = (
    "transcript_id string, source_file string, engine string, language string, duration_s double, segment_count bigint, "
    "part bigint, segments array<struct<seg_idx:bigint,start_ms:bigint,end_ms:bigint,text:string,speaker:string,confidence:double>>"
)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts as written by :func:`cueline.sources.writers.write_canonical`."""
    docs = spark.read.schema(CANONICAL).json(path)
    return docs.select(
        "transcript_id", "source_file", "engine", F.coalesce("language", F.lit("zh")).alias("language"), "duration_s", F.inline("segments")
    ).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def canonical_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per transcript: its header, the number of its documents and of the segments they hold."""
    docs = spark.read.schema(CANONICAL).json(path)
    return docs.groupBy("transcript_id").agg(
        F.max("source_file").alias("source_file"), F.max("engine").alias("engine"), F.max(F.coalesce("language", F.lit("zh"))).alias("language"),
        F.max("duration_s").alias("duration_s"), F.max("segment_count").alias("segment_count"), F.count(F.lit(1)).alias("n_parts"),
        F.sum(F.size("segments")).alias("n_segments"),
    )


def _ordered_lines(spark: SparkSession, path: str, suffix: str, folders: bool) -> DataFrame:
    """Lines of every file, whatever their line ends, with their number in the file.

    With ``folders`` the part files of a folder are one document, in order of
    name, as :func:`cueline.sources.writers.write_text` leaves them; its path is
    the folder's. Files are read in splits. A line's place is (file, split
    offset, order in the split); numbering needs no more than one split in one
    task."""
    file = F.col("_metadata.file_path")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{suffix}")
    lines = reader.text(path).select(
        (F.regexp_replace(file, "/[^/]*$", "") if folders else file).alias("path"),
        F.element_at(F.split(file, "/"), -1).alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value"),
    )
    return dense_position(materialise(lines, "lines"), ["path"], ["_file", "_split"], ["_id"], "line_no").drop("_file", "_split", "_id")


def read_srt(spark: SparkSession, path: str, suffix: str = "srt", folders: bool = False) -> DataFrame:
    """Entries of a folder of SRT files; blocks that do not parse are skipped.

    Blocks end at an empty line. Lines may end in CR, LF or both, mixed in a
    file. ``line_no`` is the number of the block's first line. ``folders``: each
    folder is one document in part files."""
    lines = _ordered_lines(spark, path, suffix, folders).withColumn("_empty", (F.col("value") == "").cast("int"))
    marked = running_total(lines, ["path"], "line_no", {"_number": "_empty"}).where("_empty = 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "value"))), lambda line: line["value"]), "\n")
    blocks = marked.groupBy("path", "_number").agg(F.min("line_no").alias("line_no"), joined.alias("value")).withColumn(
        "value", F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    )
    lines = F.split("value", "\n")
    times = F.split(F.get(lines, F.lit(1)), " --> ")
    rows = blocks.where(F.size(lines) >= 3).select(
        "path", "line_no",
        F.trim(F.get(lines, F.lit(0))).try_cast("int").alias("index"),
        F.when(F.size(times) == 2, parse_srt_time(F.get(times, F.lit(0)))).alias("start_ms"),
        F.when(F.size(times) == 2, parse_srt_time(F.get(times, F.lit(1)))).alias("end_ms"),
        F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n").alias("text"),
    )
    return rows.where("index is not null and start_ms is not null and end_ms is not null").select(
        file_id(F.col("path")).alias("file_id"), "line_no", "index", "start_ms", "end_ms", "text", "path"
    )


def read_ass(spark: SparkSession, path: str, suffix: str = "ass", folders: bool = False) -> DataFrame:
    """Dialogue entries of a folder of ASS files, numbered from 1 per file.

    Only dialogue lines of the events section count. Override tags are removed;
    empty lines, drawing commands and texts starting with a digit are dropped.
    ``folders``: each folder is one document in part files, of which only the
    first has the header.
    """
    lines = materialise(_ordered_lines(spark, path, suffix, folders).withColumn("value", F.regexp_replace("value", r"(?U)^\s+|\s+$", "")), "ass-lines")
    events = F.col("value") == "[Events]"
    other = F.col("value").rlike(r"^\[.*\]$") & ~events
    marked = lines.withColumns({"_e": F.when(events, F.col("line_no")), "_o": F.when(other, F.col("line_no"))})
    marked = running_max(marked, ["path"], "line_no", {"_events": "_e", "_other": "_o"})
    parts = F.split("value", ",", 10)
    text = F.regexp_replace(F.regexp_replace(F.get(parts, F.lit(9)), r"\{[^}]*\}", ""), r"(?U)^\s+|\s+$", "")
    kept = (
        marked.where(F.col("_events") > F.coalesce("_other", F.lit(-1)))
        .where(F.col("value").startswith("Dialogue:") & (F.size(parts) == 10))
        .select(
            "path", "line_no", parse_ass_time(F.get(parts, F.lit(1))).alias("start_ms"),
            parse_ass_time(F.get(parts, F.lit(2))).alias("end_ms"), text.alias("text"),
        )
        .where((F.col("text") != "") & ~F.col("text").rlike(r"^[mbls]\s") & ~F.col("text").rlike(r"^\d"))
    )
    blocked = kept.withColumn("_range", F.floor(F.col("line_no") / 50_000))
    numbered = dense_position(blocked, ["path"], ["_range"], ["line_no"], "_pos")
    return numbered.select(
        file_id(F.col("path")).alias("file_id"), (F.col("_pos") + 1).alias("index"), "start_ms", "end_ms", "text", "path"
    )


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Literal rules as JSON: ``{category: {wrong: correct}}``; other keys are ignored."""
    from cueline.params import RULE_CATEGORIES

    schema = ", ".join(f"{c} map<string,string>" for c in RULE_CATEGORIES)
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    each = F.array(
        *[F.struct(F.lit(c).alias("category"), F.map_entries(F.col(c)).alias("entries")) for c in RULE_CATEGORIES]
    )
    rows = docs.select(F.inline(each)).select("category", F.posexplode("entries").alias("rule_order", "e"))
    return rows.select("category", "rule_order", F.col("e.key").alias("wrong"), F.col("e.value").alias("correct"))


_FIRST = "first_order bigint"
"""A list may be spread over many files, each with the place of its first rule in the whole list."""


def _rule_order() -> Column:
    return (F.coalesce("first_order", F.lit(0)) + F.col("_at")).cast("long").alias("rule_order")


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Flat corrections ``{"corrections": {wrong: correct}}`` as rules of category custom."""
    docs = spark.read.schema(f"{_FIRST}, corrections map<string,string>").option("multiLine", True).json(path)
    return docs.select("first_order", F.posexplode(F.map_entries("corrections")).alias("_at", "e")).select(
        F.lit("custom").alias("category"), _rule_order(), F.col("e.key").alias("wrong"), F.col("e.value").alias("correct")
    )


def read_regex_rules(spark: SparkSession, path: str) -> DataFrame:
    """Regex rules ``rule_order, pattern, replacement`` in list order, usable or not."""
    docs = spark.read.schema(f"{_FIRST}, asr_phonetic_patterns array<struct<pattern:string,replacement:string>>").option("multiLine", True).json(path)
    return docs.select("first_order", F.posexplode("asr_phonetic_patterns").alias("_at", "r")).select(_rule_order(), "r.pattern", "r.replacement")


def read_semantic_rules(spark: SparkSession, path: str) -> DataFrame:
    """Semantic rules ``rule_order, pattern, correction, description`` in list order, usable or not."""
    fields = "semantic_patterns array<struct<pattern:string,correction:string,description:string>>"
    docs = spark.read.schema(f"{_FIRST}, {fields}").option("multiLine", True).json(path)
    return docs.select("first_order", F.posexplode("semantic_patterns").alias("_at", "r")).select(_rule_order(), "r.pattern", "r.correction", "r.description")


def read_char_map(spark: SparkSession, path: str) -> DataFrame:
    """Character pairs ``traditional, simplified`` from a JSON object of one-to-one entries."""
    docs = spark.read.option("multiLine", True).option("singleVariantColumn", "doc").json(path)
    pairs = docs.select(F.explode(F.map_entries(F.try_variant_get("doc", "$", "map<string,string>"))).alias("e"))
    return pairs.select(F.col("e.key").alias("traditional"), F.col("e.value").alias("simplified"))


def read_clips(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Clip definitions ``{series: [clip, …]}`` as one row per clip."""
    fields = (
        "id string, title string, description string, start_s double, end_s double, domain string, hook string, chapter string"
    )
    docs = spark.read.option("multiLine", multi_line).option("singleVariantColumn", "doc").json(path)
    lists = docs.select(F.explode(F.map_entries(F.try_variant_get("doc", "$", f"map<string,array<struct<{_struct(fields)}>>>"))).alias("e"))
    rows = lists.select(F.col("e.key").alias("series"), F.inline("e.value"))
    return rows.withColumnRenamed("id", "clip_id").withColumns(
        {"start_ms": (F.col("start_s") * 1000).cast("long"), "end_ms": (F.col("end_s") * 1000).cast("long")}
    )


def _struct(fields: str) -> str:
    return ",".join(":".join(f.split()) for f in fields.split(","))


LOG = "timestamp string, level string, component string, message string, data string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The research log, one JSON object per line; broken lines are skipped."""
    return spark.read.schema(LOG).option("mode", "DROPMALFORMED").json(path).where("level is not null")


def read_summaries(spark: SparkSession, path: str, pattern: str = "summary.json", multi_line: bool = True) -> DataFrame:
    """Generated and skipped counts of every ``summary.json`` below a folder."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    rows = (
        reader.schema("generated_count bigint, generated bigint, skipped_count bigint, skipped bigint, total_time_s double")
        .option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)
    )
    zero = F.lit(0)
    return rows.select(
        F.coalesce("generated_count", "generated", zero).alias("generated"),
        F.coalesce("skipped_count", "skipped", zero).alias("skipped"),
        F.coalesce("total_time_s", F.lit(0.0)).alias("total_time_s"),
        F.col("_metadata.file_path").alias("path"),
    )


REPORT = (
    "version_key string, overall_score double, passed boolean, critical_count bigint, warning_count bigint, recommendations array<string>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes of files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .load(path).select("path", "length", "modificationTime")
    )


def read_ass_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole ASS files as ``path, content`` for the style check; a style header and
    its drawing tags may be anywhere in the file."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.ass").option("wholetext", True)
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
