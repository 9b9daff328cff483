"""Tables by name, and adapters that turn other tables into ordered steps."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W


@dataclass(frozen=True)
class Catalog:
    """Finds a table below the first base that has it."""

    spark: SparkSession
    bases: tuple[str, ...]

    def table(self, name: str, columns: list[str] | None = None) -> DataFrame:
        for base in self.bases:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}.parquet")
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
                df = self.spark.read.parquet(f"{base}/{name}.parquet")
                return df.select(*columns) if columns else df
        raise FileNotFoundError(f"no table {name} below {', '.join(self.bases)}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary
    one only where it names none, as in local tests."""
    context, named = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written into the shared folder and read back: cuts the lineage, and
    with it the constraints that a checkpoint would carry on from round to round."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of keys and a few numbers that are broadcast at most.
FEW = 200_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, to be read of a stored table, broadcast in joins if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a file or directory; lines that are not JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON document of many lines as one row."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_verdicts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON-lines files of a folder, each with the file it came from."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1))


def probe(df: DataFrame) -> DataFrame:
    """Name, type, rows and nulls of each column, in one pass."""
    counts = [F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]]
    each = [F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"), F.lit(t).alias("type"), F.col("_rows").alias("rows"), F.col(f"`{c}`").alias("nulls")) for i, (c, t) in enumerate(df.dtypes)]
    return df.agg(*counts).select(F.explode(F.array(*each)).alias("c")).select("c.*")


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def write_summary(df: DataFrame, path: str) -> None:
    """A summary of few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_missing(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key is not yet below ``path``, one row of each, so
    that an interrupted run can be resumed. A null key is a key like others."""
    df = df.dropDuplicates([key])
    try:
        done = df.sparkSession.read.schema(df.schema).json(path).select(F.col(key).alias("_done"))
        df = df.join(done, F.col(key).eqNullSafe(F.col("_done")), "left_anti")
    except Exception as error:  # nothing was written yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
    df.write.mode("append").json(path)


def left_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 8) -> DataFrame:
    """Left join over salts, as a key may have a large share of the left rows: an
    unmatched row stays, a key that ``right`` repeats gives a row for each."""
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Never broadcast: the estimate of its size does not count the salts.
    return salted.join(spread.hint("merge"), [*keys, "_salt"], "left").drop("_salt")


def key_audit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, keys, keys of more than one row, and the most rows of a key."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.max("n").alias("most"))


def lineitem_steps(spark: SparkSession, base: str) -> DataFrame:
    """Orders as scenarios: repository = region and nation, file = customer. Lines
    are dealt twice, by part and by order; the places within orders follow from the
    second dealing."""
    t = Catalog(spark, (base,)).table
    kind = F.col("p_size") % 4
    first_word = F.substring_index("p_name", " ", 1)
    text = F.when(kind == 0, F.concat(F.lit('set "'), "p_type", F.lit('" "'), first_word, F.lit('"'))).when(kind == 1, F.concat(F.lit("check <"), "p_type", F.lit(">"))).otherwise(F.col("p_type"))
    parts = t("part", ["p_partkey", "p_name", "p_type", "p_size"]).select("p_partkey", F.when(F.col("p_size") <= 46, kind).cast("int").alias("cluster_id"), text.alias("text"))
    orders = (
        t("orders", ["o_orderkey", "o_custkey"])
        .join(t("customer", ["c_custkey", "c_nationkey"]), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation", ["n_nationkey", "n_name", "n_regionkey"]), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("region", ["r_regionkey", "r_name"]), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("o_orderkey", F.concat_ws("_", "r_name", "n_name").alias("repo_slug"), F.col("c_custkey").cast("string").alias("file_path"))
    )
    lines = t("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"])
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    order = W.Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return joined.select(
        "repo_slug",
        "file_path",
        F.col("o_orderkey").cast("string").alias("scenario"),
        F.row_number().over(order).alias("line"),
        "cluster_id",
        "text",
        ((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)).alias("is_background"),
    )


#: The codes of the event types.
EVENT_CODES = {"click": 0, "view": 1, "purchase": 2, "signup": 3, "error": 4}


def event_steps(spark: SparkSession, base: str, two_symbols: bool = False) -> DataFrame:
    """Users' event sequences as scenarios; with two symbols, errors against others."""
    events = Catalog(spark, (base,)).table("events", ["event_id", "ts", "user_id", "event_type"])
    order = W.Window.partitionBy("user_id").orderBy("ts", "event_id")
    code = F.when(F.col("event_type") == "error", 0).otherwise(1) if two_symbols else F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_CODES.items()], F.lit(5))
    return events.select(
        F.concat(F.lit("org"), F.col("user_id") % 4, F.lit("_repo"), F.col("user_id") % 8).alias("repo_slug"),
        F.concat(F.lit("f"), F.col("user_id") % 40).alias("file_path"),
        F.col("user_id").cast("string").alias("scenario"),
        F.row_number().over(order).alias("line"),
        code.cast("int").alias("cluster_id"),
        F.col("event_type").alias("text"),
        F.lit(False).alias("is_background"),
    )
