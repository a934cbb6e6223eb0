"""The test tables as record-store data: mutation logs, items and file metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.schema import DELETE, PUT, RANGE_DELETE

PARTITIONS = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def mutation_rows(events: DataFrame) -> DataFrame:
    """``events`` as changes of user records; works on a stream too.

    error deletes click:k, signup deletes the range [view:k, view:k+20), all others put type:k.
    """
    k = F.lpad(F.regexp_extract("props", r'"k": *([0-9]+)', 1), 3, "0")
    kind = F.col("event_type")
    op = F.when(kind == "error", DELETE).when(kind == "signup", RANGE_DELETE).otherwise(PUT)
    key = F.when(kind == "error", F.concat(F.lit("click:"), k)).when(kind == "signup", F.concat(F.lit("view:"), k)).otherwise(F.concat(kind, F.lit(":"), k))
    end = F.when(kind == "signup", F.concat(F.lit("view:"), F.lpad((k.cast("int") + 20).cast("string"), 3, "0")))
    record = F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    ms = F.expr("cast(floor(cast(extract(SECOND FROM ts) * 1000 AS DECIMAL(20, 3))) AS BIGINT) + 1000 * (60 * (60 * (24 * cast(datediff(cast(ts AS DATE), DATE'1970-01-01') AS BIGINT) + hour(ts)) + minute(ts)))")
    return events.select(
        F.lit("events").alias("namespace"),
        F.crc32(record.cast("binary")).bitwiseAND(F.lit(PARTITIONS - 1).cast("long")).cast("int").alias("partition_id"),
        record.alias("record_id"),
        key.cast("binary").alias("item_key"),
        op.alias("op"),
        end.cast("binary").alias("range_end"),
        F.when(op == PUT, F.col("props")).otherwise("").cast("binary").alias("value"),
        F.lit(b"").alias("metadata"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"), k).cast("binary").alias("token"),
        (F.col("event_id") + 1).cast("long").alias("seq"),
        ms.alias("created_at_ms"),
    )


def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutation_rows(read(spark, sf_dir, "events"))


def _items(df: DataFrame, namespace: str, record: Column, key: Column, value: Column) -> DataFrame:
    return df.select(F.lit(namespace).alias("namespace"), record.alias("record_id"), key.cast("binary").alias("item_key"), value.cast("binary").alias("value"), F.lit(b"").alias("metadata"), F.lit(0).alias("chunk"), F.lit(1).cast("long").alias("seq"))


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted events: a record for each order, an item for each line and part. The table repeats some; one stays."""
    record = F.concat(F.lit("order:"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"))
    key = F.concat(F.lit("line:"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(":"), F.lpad(F.col("l_partkey").cast("string"), 9, "0"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max(F.concat_ws("|", "l_returnflag", "l_linestatus")).alias("v"))
    return _items(lines, "orders", record, key, F.col("v"))


def customer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple key-value: one item with an empty key."""
    return _items(read(spark, sf_dir, "customer"), "customers", F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")), F.lit(""), F.col("c_name"))


def adjacency_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph: regions point to their nations."""
    n = read(spark, sf_dir, "nation")
    return _items(n, "graph", F.concat(F.lit("region:"), F.col("n_regionkey").cast("string")), F.concat(F.lit("nation:"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")), F.col("n_name"))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: text and language as items; texts are not ASCII, so that bytes and characters differ."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pairs = F.explode(F.array(F.struct(F.lit("lang").alias("k"), F.col("lang").alias("v")), F.struct(F.lit("text").alias("k"), F.col("text").alias("v")))).alias("p")
    return _items(d.select("doc_id", pairs), "documents", F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 10, "0")), F.col("p.k"), F.col("p.v"))


def turn_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time series: the turns of a conversation."""
    c = read(spark, sf_dir, "conversations")
    return _items(c, "conversations", F.concat(F.lit("conv:"), F.col("conv_id").cast("string")), F.concat(F.lit("turn:"), F.lpad(F.col("turn").cast("string"), 6, "0")), F.col("text"))


def products(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """A product catalogue to load and time the store with: info, price, inventory, variants, reviews.

    Every product's items follow from its number and the seed. Variants may repeat a key, so that
    the last of a batch wins.
    """
    draw = lambda name, most: F.pmod(F.xxhash64(F.col("id") + seed, F.lit(name), F.col("k")), F.lit(most))
    one = lambda name: F.pmod(F.xxhash64(F.col("id") + seed, F.lit(name)), F.lit(1 << 30))
    base = spark.range(n)

    def some(kind: str, low: int, high: int) -> Column:
        last = (F.lit(low) + F.pmod(one(kind), F.lit(high - low + 1))).cast("int")
        return F.transform(F.sequence(F.lit(1), last), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("k")))

    rows = F.flatten(
        F.array(
            F.array(F.struct(F.lit("info").alias("kind"), F.lit(0).alias("k")), F.struct(F.lit("price").alias("kind"), F.lit(0).alias("k"))),
            *[some(*x) for x in (("inventory", 1, 3), ("variant", 2, 6), ("review", 1, 5))],
        )
    )
    e = base.select("id", F.posexplode(rows).alias("ord", "r")).select("id", "ord", "r.kind", "r.k")
    warehouse = F.element_at(F.array(*map(F.lit, ("east", "north", "west"))), F.col("k"))
    colour = F.element_at(F.array(*map(F.lit, ("black", "blue", "green", "red", "white"))), (draw("colour", 5) + 1).cast("int"))
    size = F.element_at(F.array(*map(F.lit, ("L", "M", "S", "XL"))), (draw("size", 4) + 1).cast("int"))
    key = F.when(F.col("kind") == "inventory", F.concat(F.lit("inventory:"), warehouse)).when(F.col("kind") == "variant", F.concat(F.lit("variant:"), colour, F.lit(":"), size)).when(F.col("kind") == "review", F.concat(F.lit("review:"), (F.lit(1700000000000) + draw("when", 10**10)).cast("string"))).otherwise(F.col("kind"))
    price = draw("price", 100000) + 100
    value = (
        F.when(F.col("kind") == "info", F.to_json(F.struct(F.concat(F.lit("Product "), F.col("id")).alias("name"), F.lit("A product").alias("description"), F.concat(F.lit("category "), draw("category", 20)).alias("category"), F.concat(F.lit("brand "), draw("brand", 50)).alias("brand"))))
        .when(F.col("kind") == "price", F.to_json(F.struct(price.alias("current_cents"), (price + draw("off", 5000)).alias("original_cents"), F.lit("USD").alias("currency"))))
        .when(F.col("kind") == "inventory", F.to_json(F.struct(draw("count", 500).alias("count"), draw("reserved", 50).alias("reserved"))))
        .when(F.col("kind") == "variant", F.to_json(F.struct(F.concat(F.lit("-"), F.col("k")).alias("sku_suffix"), draw("extra", 2000).alias("extra_cents"), (draw("stock", 2) == 1).alias("in_stock"))))
        .otherwise(F.to_json(F.struct((draw("rating", 5) + 1).alias("rating"), F.concat(F.lit("user "), draw("author", 1000)).alias("author"), F.lit("Title").alias("title"), F.lit("Body").alias("body"))))
    )
    record = F.concat(F.lit("product:"), F.lpad(F.col("id").cast("string"), 6, "0"))
    return e.select(record.alias("record_id"), "ord", key.cast("binary").alias("item_key"), value.cast("binary").alias("value"))


def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files as metadata: one for each day and event type, with levels dealt by day."""
    from lodestore.operators.maintenance import file_stats

    log = mutation_log(spark, sf_dir)
    day = F.expr("created_at_ms div 86400000")
    files = file_stats(log.withColumn("day", day), ["day", "partition_id"])
    level = F.when(F.pmod("day", F.lit(7)) == 0, 0).otherwise(F.pmod("day", F.lit(3)) + 1)
    return files.select(F.concat_ws("-", F.lpad(F.col("day").cast("string"), 6, "0"), F.lpad(F.col("partition_id").cast("string"), 2, "0")).alias("id"), level.cast("int").alias("level"), "size_bytes", "entry_count", "min_key", "max_key", "seq_min", "seq_max", "record_id_count", (F.col("day") * 86400000).alias("created_at_ms"))
