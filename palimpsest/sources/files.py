"""Scenes, personas, diagrams, seeds and profiles in files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx

#: The index of scenes, below a memory folder.
INDEX = ".metadata/scene_index.json"
META_START, META_END = "-----META-START-----", "-----META-END-----"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, raw) of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("raw"))


def parse_scenes(files: DataFrame) -> DataFrame:
    """(filename, summary, heat, created, updated, body) of (filename, raw).

    A header is between the first start and the first end mark, wherever they are; what follows
    it is the body.  A file without both marks is all body."""
    raw = F.col("raw")
    a, b = F.locate(META_START, raw), F.locate(META_END, raw)
    has = (a > 0) & (b > a)
    meta = tx.strip(F.substring(raw, a + len(META_START), b - a - len(META_START)))
    own = lambda name: F.get(F.filter(F.split(meta, "\r?\n"), lambda x: x.startswith(f"{name}:")), F.lit(0))
    field = lambda name: F.when(has, F.coalesce(tx.strip(F.substring(own(name), F.lit(len(name) + 2), F.length(raw))), F.lit(""))).otherwise("")
    body = tx.strip(F.when(has, F.substring(raw, b + len(META_END), F.length(raw))).otherwise(raw))
    return files.select("filename", field("summary").alias("summary"), F.coalesce(field("heat").try_cast("long"), F.lit(0).cast("long")).alias("heat"), field("created").alias("created"), field("updated").alias("updated"), body.alias("body"))


def format_scene(summary: Column, heat: Column, created: Column, updated: Column, body: Column) -> Column:
    return F.concat(F.format_string("-----META-START-----\ncreated: %s\nupdated: %s\nsummary: %s\nheat: %s\n-----META-END-----\n\n", created, updated, summary, heat.cast("string")), body)


def scenes(spark: SparkSession, base_dir: str) -> DataFrame:
    """All scenes, those that are blank, deleted or without a body left out."""
    files = whole_files(spark, f"{base_dir}/scene_blocks/*.md")
    return parse_scenes(files.where(~tx.strip(F.col("raw")).isin("", "[DELETED]"))).where(tx.strip(F.col("body")) != "")


def scene_index(spark: SparkSession, base_dir: str) -> DataFrame:
    """The index of a memory folder; entries without a filename are dropped, and a missing or
    malformed file has none."""
    path = f"{base_dir}/{INDEX}"
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schemas.SCENE_INDEX)
    return spark.read.schema(schemas.SCENE_INDEX).option("multiLine", True).json(path).where("filename <> ''")


def navigation(found: DataFrame) -> DataFrame:
    """(rank, line): scenes by heat, the hottest first."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.desc("heat"), "filename"))
    return found.select(rank.alias("rank"), F.concat(F.lit("- "), F.col("filename"), F.lit(" "), tx.heat_mark(F.col("heat")), F.lit(" "), F.col("summary")).alias("line"))


def diagrams(spark: SparkSession, path: str) -> DataFrame:
    """(filename, goal, done, doing, todo) of task diagrams; counts are of substrings."""
    count = lambda word: (F.size(F.split("raw", word)) - 1).alias(word)
    head = F.regexp_extract("raw", r"%%(\{.*?\})%%", 1)
    return whole_files(spark, path).select("filename", F.get_json_object(head, "$.taskGoal").alias("goal"), count("done"), count("doing"), count("todo"))


def profiles(spark: SparkSession, base_dir: str) -> DataFrame:
    """(type, filename, content) of scene files, and of the persona without its navigation."""
    blocks = whole_files(spark, f"{base_dir}/scene_blocks/*.md").select(F.lit("l2").alias("type"), "filename", F.col("raw").alias("content"))
    persona = whole_files(spark, f"{base_dir}/persona.md").select(F.lit("l3").alias("type"), "filename", strip_navigation(F.col("raw")).alias("content"))
    return blocks.unionByName(persona).where(tx.strip(F.col("content")) != "")


def strip_navigation(text: Column) -> Column:
    return tx.strip(F.regexp_replace(text, r"(?s)\n*<scene-navigation>.*$", ""))


def read_seed(spark: SparkSession, path: str, fallback_key: str = "seed") -> DataFrame:
    """A seed's messages: session, round, place, role, content, timestamp, and the first ``error``.

    The file is {sessions: […]} or the bare array.  Times are whole milliseconds or RFC 3339;
    if all are missing they are filled, and a mixture is an error.
    """
    raw = whole_files(spark, path).select(F.regexp_replace("raw", r"(?s)^\s*(\[.*\])\s*$", '{"sessions": $1}').alias("j"))
    s = raw.select(F.posexplode_outer(F.from_json("j", schemas.SEED)["sessions"]).alias("session", "s"))
    r = s.select("session", F.coalesce("s.sessionKey", F.lit(fallback_key)).alias("session_key"), F.col("s.sessionId").alias("session_id"), F.posexplode_outer("s.conversations").alias("round", "c"))
    m = r.select("session", "session_key", "session_id", "round", F.posexplode_outer("c").alias("place", "m")).select("session", "session_key", "session_id", "round", "place", "m.role", "m.content", "m.timestamp")
    at = tx.parse_time_ms(F.col("timestamp"))
    error = F.when(F.col("session").isNull(), "no sessions").when(F.col("place").isNull(), "an empty round").when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "a role other than user and assistant").when(F.coalesce(tx.strip(F.col("content")), F.lit("")) == "", "no content").when(F.col("timestamp").isNotNull() & at.isNull(), "not a time")
    return m.withColumn("error", error).withColumn("timestamp", at)


def fill_times(seed: DataFrame, start_ms: int) -> DataFrame:
    """Messages 100 ms apart in order, if no time is given; a mixture becomes an error.

    The place of a message among all is that in its session, after the messages of the sessions
    before; the table of sessions is what is put in one order."""
    from pyspark.sql import Window

    counts = seed.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.count("timestamp").alias("g"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("session").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = counts.agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    given, size = int(total[0]), int(total[1])
    rows = seed.join(counts.select(F.col("session").alias("_s"), before.alias("_before")), F.col("session").eqNullSafe(F.col("_s")))
    n = F.row_number().over(Window.partitionBy("session").orderBy("round", "place")) - 1
    mixed = F.when(F.lit(0 < given < size), "some messages have times and some do not")
    filled = F.lit(start_ms) + 100 * (F.col("_before") + n) if given == 0 else F.col("timestamp")
    return rows.withColumns({"error": F.coalesce("error", mixed), "timestamp": filled.cast("long")}).drop("_s", "_before")


def round_keys(seed: DataFrame) -> DataFrame:
    """(session_key, round, key): a key of a round's content, for replays without repeats."""
    text = F.concat_ws("\x1f", F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "content"))), lambda x: F.concat_ws("\x1e", x["role"], x["content"])))
    return seed.groupBy("session_key", "round").agg(text.alias("t")).select("session_key", "round", F.sha2(F.concat_ws("\x1d", "session_key", "round", "t").cast("binary"), 256).alias("key"))
