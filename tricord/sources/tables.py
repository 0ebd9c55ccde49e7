"""Sources and sinks: Parquet tables, whitespace text, id lists, triplets, factors, parameters, generated data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tricord.plans.storage import materialize

TRIPLET = "u long, b long, rating double"
EDGE = "src long, dst long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(u, b, rating): the last line of each customer and part, its quantity on a scale of 1 to 5."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    seq = F.struct("o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    last = joined.groupBy(F.col("o_custkey").cast("long").alias("u"), F.col("l_partkey").cast("long").alias("b")).agg(F.max(seq)["l_quantity"].alias("q"))
    return last.select("u", "b", F.ceil(F.col("q") / 10).cast("double").alias("rating"))


def trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): distinct pairs of users of consecutive events, no loops."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("e"), F.col("user_id").cast("long").alias("user"))
    after = events.select((F.col("e") - 1).alias("e"), F.col("user").alias("dst"))
    return events.join(after, "e").where("user <> dst").select(F.col("user").alias("src"), "dst").distinct()


def read_numbers(spark: SparkSession, path: str, schema: str = TRIPLET) -> DataFrame:
    """Whitespace-delimited numbers without a header. Blank lines are skipped; a number that a
    column's type can't hold is null; missing columns are null."""
    kinds = T._parse_datatype_string(schema)
    parts = F.split(F.trim(F.col("value")), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    # "3.0" is a valid id in such files
    one = lambda k, f: F.get("p", F.lit(k)).try_cast("double").try_cast(f.dataType) if isinstance(f.dataType, (T.LongType, T.IntegerType)) else F.get("p", F.lit(k)).try_cast(f.dataType)
    return rows.select(*[one(k, f).alias(f.name) for k, f in enumerate(kinds)])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """An id a line."""
    return read_numbers(spark, path, "id long")


def read_factors(spark: SparkSession, path: str, rank: int) -> DataFrame:
    """Lines of an id and ``rank`` numbers -> (id, features)."""
    rows = read_numbers(spark, path, "id long, " + ", ".join(f"f{k} double" for k in range(rank)))
    return rows.select("id", F.array(*[f"f{k}" for k in range(rank)]).alias("features"))


def write_lines(df: DataFrame, path: str, pattern: str, *columns: str, mode: str = "overwrite") -> None:
    """Lines of ``columns`` in a printf pattern such as ``%d\\t%d\\t%.1f``."""
    df.select(F.format_string(pattern, *columns).alias("value")).write.mode(mode).text(path)


def write_triplets(df: DataFrame, path: str, append: bool = False) -> None:
    """Tab-separated (u, b, score); ``append`` adds to what is there."""
    u, b, score = df.columns[:3]
    df.select(F.concat_ws("\t", F.col(u), F.col(b), F.col(score)).alias("value")).write.mode("append" if append else "overwrite").text(path)


def write_factors(df: DataFrame, path: str) -> None:
    """(.., id, features) as Parquet, by graph and rank where it has those columns."""
    keys = [c for c in ("graph", "alpha_step", "rank") if c in df.columns]
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def write_parameters(spark: SparkSession, weights, factors, bias: float, path: str) -> None:
    """The parameters of a factorisation machine: a row per feature, and the bias as feature -1."""
    rows = [(k, float(w), [float(x) for x in p]) for k, (w, p) in enumerate(zip(weights, factors, strict=True))]
    spark.createDataFrame([(-1, float(bias), []), *rows], "feature long, w double, p array<double>").write.mode("overwrite").parquet(path)


def random_design(spark: SparkSession, rows: int = 1000, width: int = 80, seed: int = 1) -> DataFrame:
    """(x, y): normal features and uniform targets."""
    return spark.range(rows).select(F.array(*[F.randn(seed + k) for k in range(width)]).alias("x"), F.rand(seed + width).alias("y"))


def read_design(spark: SparkSession, x_path: str, y_path: str) -> DataFrame:
    """(x, y) of a design matrix kept as two texts: a row of whitespace-delimited numbers a line, and its target.

    Lines are matched by their place in the files, blank ones left out; files of different lengths, or a line
    that isn't a target or has another width than the first, are errors. One file each, of any size.
    """
    x, y = (_placed(spark, path) for path in (x_path, y_path))
    numbers = F.transform(F.split(F.trim("value"), r"\s+"), lambda v: v.try_cast("double"))
    rows = x.select("line", numbers.alias("x")).join(y.select("line", F.trim("value").try_cast("double").alias("y")), "line", "full")
    first = x.where("line = 0").select(F.size(F.split(F.trim("value"), r"\s+")).alias("_width"))  # a single row
    rows = rows.join(F.broadcast(first), how="left")
    right = F.col("x").isNotNull() & F.col("y").isNotNull() & (F.size("x") == F.col("_width")) & ~F.exists("x", lambda v: v.isNull())
    wrong = F.raise_error(F.concat(F.lit("not a row of a design matrix: line "), F.col("line").cast("string"))).cast("array<double>")
    return rows.select(F.when(right, F.col("x")).otherwise(wrong).alias("x"), "y")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, its lines that aren't blank numbered from 0."""
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(F.trim("value") != "")
    # the upper bits of an id are its partition, and partitions of one file stand in its order
    rows = rows.withColumn("part", F.shiftright("at", 33))
    starts = rows.groupBy("part").agg(F.count("*").alias("n"))
    starts = starts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for each partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy("at"))
    return rows.withColumn("rank", rank).join(F.broadcast(starts), "part").select((F.col("start") + F.col("rank") - 1).alias("line"), "value")


def write_design(design: DataFrame, x_path: str, y_path: str) -> None:
    """(x, y) as two texts that ``read_design`` takes, a file each: a task writes it line by line. Rows are numbered and written
    once, and both texts follow these numbers, so that line n of the one belongs to line n of the other."""
    rows = design.select(F.concat_ws(" ", F.transform("x", lambda v: v.cast("string"))).alias("x"), F.col("y").cast("string").alias("y"))
    placed = materialize(rows.select(F.monotonically_increasing_id().alias("line"), "x", "y"), "design-lines")
    for name, path in (("x", x_path), ("y", y_path)):
        placed.select("line", F.col(name).alias("value")).orderBy("line").select("value").coalesce(1).write.mode("overwrite").text(path)
