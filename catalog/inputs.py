"""JSON rows, schema logs and schema collections derived from the relational tables.

Variations are rules on columns, so that plain SQL can tell what a query must find.
Each input covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows_of(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose rows become JSON one by one."""
    return table(spark, folder, name).select(*columns)


def every(column: str, n: int) -> Column:
    return F.col(column) % n == 0


# --- flat rows from orders --------------------------------------------------------------


def flat_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, value)``; every 7th lacks ``prio``, every 11th has a text for its
    ``price``, every 13th an additional ``note``."""

    def record(price: Column) -> Column:
        return F.to_json(
            F.struct(
                F.col("o_orderkey").alias("key"),
                F.col("o_custkey").alias("cust"),
                F.col("o_orderstatus").alias("status"),
                price.alias("price"),
                F.when(~every("o_orderkey", 7), F.col("o_orderpriority")).alias("prio"),
                F.when(every("o_orderkey", 13), "x").alias("note"),
            )
        )

    price = F.col("o_totalprice")
    orders = rows_of(
        spark,
        folder,
        "orders",
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_totalprice",
        "o_orderpriority",
    )
    return orders.select(
        F.col("o_orderkey").alias("key"),
        F.when(every("o_orderkey", 11), record(price.cast("string")))
        .otherwise(record(price))
        .alias("value"),
    )


DEEP = 24


def deep_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The flat rows, each inside as many objects as ``DEEP`` says."""
    around = F.concat(F.lit('{"in":' * DEEP), F.col("value"), F.lit("}" * DEEP))
    return flat_rows(spark, folder).select("key", around.alias("value"))


_FLAT_PROPERTIES = (
    '"properties":{"key":{"type":"integer"},"cust":{"type":"number"},'
    '"status":{"type":"string"},"price":{"type":"number"},"prio":{"type":"string"}}'
)
FLAT = '{"type":"object",%s,"required":["key","cust","status","price"]}' % _FLAT_PROPERTIES
FLAT_DEEP = '{"type":"object","properties":{"in":' * DEEP + FLAT + '},"required":["in"]}' * DEEP
FLAT_ALL_REQUIRED = (
    '{"type":"object",%s,"required":["key","cust","status","price","prio"]}' % _FLAT_PROPERTIES
)
FLAT_OPEN = (
    '{"type":"object",%s,"required":["key","cust","status","price","prio"],'
    '"additionalProperties":true}' % _FLAT_PROPERTIES
)


# --- nested rows from lineitem ----------------------------------------------------------


def nested_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(key, no, qty, flag, value)``; line number modulo 4 tells the length of ``lines``, and
    every 9th order has a null for the ``flag`` of the first."""
    line = lambda i: F.struct(
        i.alias("no"),
        (F.col("l_quantity") + i).alias("qty"),
        F.when(~(every("l_orderkey", 9) & (i == 0)), F.col("l_returnflag")).alias("flag"),
    )
    length = (F.col("l_linenumber") % 4).cast("int")
    lines = F.when(
        length > 0, F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1), line)
    ).otherwise(F.array().cast("array<struct<no:int,qty:double,flag:string>>"))
    lineitem = rows_of(
        spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    return lineitem.select(
        F.col("l_orderkey").alias("key"),
        F.col("l_linenumber").cast("bigint").alias("no"),
        F.col("l_quantity").alias("qty"),
        F.col("l_returnflag").alias("flag"),
        F.to_json(
            F.struct(
                F.col("l_orderkey").alias("key"),
                F.col("l_linenumber").alias("no"),
                lines.alias("lines"),
            ),
            {"ignoreNullFields": "false"},
        ).alias("value"),
    )


def nested_schema(flag: str, limits: str = "") -> str:
    return (
        '{"type":"object","properties":{"key":{"type":"number"},"no":{"type":"number"},'
        '"lines":{"type":"array",%s"items":{"type":"object","properties":{'
        '"no":{"type":"number"},"qty":{"type":"number"},"flag":%s},'
        '"required":["no","qty","flag"]}}},"required":["key","no","lines"]}' % (limits, flag)
    )


NESTED = nested_schema('{"type":"string"}')
_TEXT_OR_NULL = '{"oneOf":[{"type":"string"},{"type":"null"}]}'
NESTED_TWO = nested_schema(_TEXT_OR_NULL, '"maxItems":2,')
NESTED_TWO_ALIAS = nested_schema(_TEXT_OR_NULL, '"maxProperties":2,')


# --- mixed rows from events, customer and conversations ---------------------------------


def mixed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, value)``. Every 10th event has an unknown ``ext`` with a key named after
    its type, every 17th empty ``props``; every 9th customer a null for ``bal``, every
    12th no ``name``; every 3rd turn no ``role``."""
    props = F.when(every("event_id", 17), "{}").otherwise(F.col("props"))
    ext = F.concat(
        F.lit(',"ext":{"a":1,"b":[{"c":true},[]],"'), F.col("event_type"), F.lit('":"x"}')
    )
    known = F.to_json(
        F.struct(
            "event_id",
            F.col("user_id").alias("user"),
            F.col("event_type").alias("etype"),
            "value",
        )
    )
    events = rows_of(
        spark, folder, "events", "event_id", "user_id", "event_type", "value", "props"
    ).select(
        F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"),
        F.concat(
            F.left(known, F.length(known) - 1),
            F.lit(',"props":'),
            props,
            F.when(every("event_id", 10), ext).otherwise(""),
            F.lit("}"),
        ).alias("value"),
    )

    turns = rows_of(spark, folder, "conversations", "conv_id", "turn", "role", "text").select(
        F.concat_ws(
            "-", F.lit("t"), F.col("conv_id").cast("string"), F.col("turn").cast("string")
        ).alias("id"),
        F.to_json(
            F.struct(
                F.col("conv_id").alias("conv"),
                "turn",
                F.when(~every("turn", 3), F.col("role")).alias("role"),
                "text",
            )
        ).alias("value"),
    )
    return events.unionByName(customer_rows(spark, folder)).unionByName(turns)


def _event(extra: str = "") -> str:
    return (
        '{"type":"object","properties":{"event_id":{"type":"number"},"user":{"type":"number"},'
        '"etype":{"type":"string"},"value":{"type":"number"},"props":{"type":"object",'
        '"properties":{"k":{"type":"number"}}}%s},"required":["event_id"]}' % extra
    )


CUSTOMER = (
    '{"type":"object","properties":{"cust":{"type":"number"},"name":{"type":"string"},'
    '"bal":{"oneOf":[{"type":"number"},{"type":"null"}]},"seg":{"type":"string"}},'
    '"required":["cust","name"]}'
)
_TURN = (
    '{"type":"object","properties":{"conv":{"type":"number"},"turn":{"type":"number"},'
    '"role":{"type":"string"},"text":{"type":"string"}},"required":["conv","turn","role"]}'
)
MIXED = '{"anyOf":[%s,%s,%s]}' % (_event(), CUSTOMER, _TURN)
# As above, with a thousand properties no event has, half of them objects.
_UNUSED = "".join(
    ',"u%d":%s'
    % (i, '{"type":"object","properties":{"v%d":{"type":"string"}}}' % i if i % 2 else '{"type":"null"}')
    for i in range(1000)
)
MIXED_WIDE = '{"anyOf":[%s,%s,%s]}' % (_event(_UNUSED), CUSTOMER, _TURN)
CUSTOMER_STRICT = CUSTOMER.replace(
    '{"oneOf":[{"type":"number"},{"type":"null"}]}', '{"type":"number"}'
)


def customer_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The customers of :func:`mixed_rows`."""

    def customer(*balance: Column) -> Column:
        return F.to_json(
            F.struct(
                F.col("c_custkey").alias("cust"),
                F.when(~every("c_custkey", 12), F.col("c_name")).alias("name"),
                F.col("c_mktsegment").alias("seg"),
                *balance,
            )
        )

    bare = customer()
    customers = rows_of(
        spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment", "c_acctbal"
    ).select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.when(
            every("c_custkey", 9),
            F.concat(F.left(bare, F.length(bare) - 1), F.lit(',"bal":null}')),
        )
        .otherwise(customer(F.col("c_acctbal").alias("bal")))
        .alias("value"),
    )
    return customers


def props_rows(spark: SparkSession, folder: str) -> DataFrame:
    """``(event_id, value)``: the ``props`` of events, every 17th empty."""
    return rows_of(spark, folder, "events", "event_id", "props").select(
        "event_id", F.when(every("event_id", 17), "{}").otherwise(F.col("props")).alias("value")
    )


# --- raw lines from events --------------------------------------------------------------


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(event_id, value)``: of five lines one is empty, one has a leading blank, one
    is an array and two are objects, of which every 25th line is broken off."""
    record = F.to_json(F.struct("event_id", "event_type"))
    turn = F.col("event_id") % 5
    return rows_of(spark, folder, "events", "event_id", "event_type").select(
        "event_id",
        F.when(turn == 0, "")
        .when(turn == 1, F.concat(F.lit(" "), record))
        .when(turn == 2, F.concat(F.lit("["), record, F.lit("]")))
        .when(F.col("event_id") % 25 == 3, F.left(record, F.length(record) - 3))
        .otherwise(record)
        .alias("value"),
    )


RAW = (
    '{"type":"object","properties":{"event_id":{"type":"number"},'
    '"event_type":{"type":"string"}}}'
)


# --- schema logs from orders ------------------------------------------------------------


def log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, file, pos, line)``: a log per order with one to three runs, in folders
    where names repeat. By order and run ``TrainPercent`` is 1.0 without a seed, 0.5, lacking, or 1.0 with a seed."""
    key = F.col("o_orderkey")
    rec = F.floor(F.col("pos") / 2).cast("bigint")
    turn = (key + rec) % 4
    info = F.to_json(
        F.struct(
            F.concat(F.lit("in"), F.col("o_custkey").cast("string")).alias("inputFile"),
            key.cast("string").alias("TotalTime"),
            F.when(turn.isin(0, 3), "1.0").when(turn == 1, "0.5").alias("TrainPercent"),
            F.col("o_custkey").alias("ValidationSize"),
            F.when(turn == 0, "None").otherwise(rec.cast("string")).alias("Seed"),
        )
    )
    schema = F.concat(
        F.lit('{"type":"object","properties":{"'), F.col("o_orderstatus"), F.lit('":{"type":"'),
        F.when(rec == 0, "string").otherwise("number"), F.lit('"}}}'),
    )
    return (
        rows_of(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
        .select("*", F.explode(F.sequence(F.lit(0), 2 * (key % 3).cast("int") + 1)).alias("p"))
        .withColumn("pos", F.col("p").cast("bigint"))
        .select(
            F.concat(F.lit("o"), key.cast("string")).alias("path"),
            F.concat(F.lit("o"), (key % 50).cast("string"), F.lit(".log")).alias("file"),
            "pos",
            F.when(F.col("pos") % 2 == 0, info).otherwise(schema).alias("line"),
        )
    )


# --- a schema per order, from lineitem --------------------------------------------------

_OF_FLAG = {
    "R": '{"type":"object","properties":{"x":{"type":"string"},"y":{"type":"number"}}}',
    "A": '{"type":"number"}',
    "N": '{"oneOf":[{"type":"string"},{"type":"null"}]}',
}
SECOND = '{"type":"object","properties":{"other":{"type":"string"}}'


def order_schemas(spark: SparkSession, folder: str, only_status: str | None = None) -> DataFrame:
    """``(schema_id, schema_json)``. A line is a property, its return flag tells of
    which sort, and status F makes it required. Every 4th schema stands beside a second
    one under ``anyOf``, every 8th is open. Line numbers are few, so an order is small.
    """
    # Lines of an order come together once, so that neither grouping shuffles again.
    lines = (
        rows_of(
            spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"
        )
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    )
    used = F.lit(True) if only_status is None else F.col("status") == only_status
    name = F.concat(F.lit('"l'), F.col("l_linenumber").cast("string"), F.lit('"'))
    sort = F.element_at(F.create_map(*[F.lit(x) for p in _OF_FLAG.items() for x in p]), F.col("flag"))
    parts = lines.groupBy("l_orderkey").agg(
        F.collect_list(F.when(used, F.concat(name, F.lit(":"), sort))).alias("properties"),
        F.collect_list(F.when(used & (F.col("status") == "F"), name)).alias("required"),
    )
    is_open = every("l_orderkey", 8)
    ending = F.when(is_open, ',"additionalProperties":true}').otherwise("}")
    document = F.concat(
        F.lit('{"type":"object","properties":{'),
        F.array_join("properties", ","),
        F.lit('},"required":['),
        F.array_join("required", ","),
        F.lit("]"),
        ending,
    )
    both = F.concat(F.lit('{"anyOf":['), document, F.lit("," + SECOND), ending, F.lit("]}"))
    return parts.select(
        F.col("l_orderkey").alias("schema_id"),
        F.when(every("l_orderkey", 4), both).otherwise(document).alias("schema_json"),
    )


def array_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """``(schema_id, schema_json)``, one per order: objects in an array, for every 3rd
    order beside texts under ``anyOf``."""
    inner = '{"type":"object","properties":{"q":{"type":"number"}}}'
    items = F.when(
        every("o_orderkey", 3), '{"anyOf":[%s,{"type":"string"}]}' % inner
    ).otherwise(inner)
    return rows_of(spark, folder, "orders", "o_orderkey").select(
        F.col("o_orderkey").alias("schema_id"),
        F.concat(
            F.lit('{"type":"object","properties":{"arr":{"type":"array","items":'),
            items,
            F.lit("}}}"),
        ).alias("schema_json"),
    )


# --- schemas per supplier and per nation ------------------------------------------------

# By supplier number modulo 4, see the algorithms a distance report has lines for.
_ALGORITHM = ("baazizi", "bimax", "kmeans", "hier")


def _brand_schemas(kinds: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and a document: brands are properties, their part types leaves below.

    ``kinds`` holds distinct keys, brands and types, and both of these are few.
    """
    leaf = F.concat(F.lit('"'), F.col("p_type"), F.lit('":{"type":"string"}'))
    brands = kinds.groupBy(*keys, "p_brand").agg(
        F.array_join(F.collect_list(leaf), ",").alias("leaves")
    )
    brand = F.concat(
        F.lit('"'),
        F.col("p_brand"),
        F.lit('":{"type":"object","properties":{'),
        F.col("leaves"),
        F.lit("}}"),
    )
    return brands.groupBy(*keys).agg(
        F.concat(
            F.lit('{"type":"object","properties":{'),
            F.array_join(F.collect_list(brand), ","),
            F.lit("}}"),
        ).alias("schema_json")
    )


def _supplier_file(number: str) -> Column:
    algorithm = F.get(F.array(*[F.lit(a) for a in _ALGORITHM]), (F.col(number) % 4).cast("int"))
    return F.concat(F.lit("s"), F.col(number).cast("string"), F.lit("."), algorithm, F.lit(".log"))


def supplier_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, schema_json)``: what a supplier sells; for every 5th one under ``anyOf``
    by whether the number of the brand is even."""
    number = F.substring("p_brand", 7, 10).cast("int")
    branch = F.when(every("l_suppkey", 5), number % 2).otherwise(F.lit(0))
    sold = (
        table(spark, folder, "lineitem")
        .select("l_partkey", "l_suppkey")
        .join(
            table(spark, folder, "part").select("p_partkey", "p_brand", "p_type"),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .select("l_suppkey", "p_brand", "p_type")
        .distinct()
        .withColumn("branch", branch)
    )
    branches = _brand_schemas(sold, ["l_suppkey", "branch"]).groupBy("l_suppkey").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("branch", "schema_json"))),
            lambda b: b["schema_json"],
        ).alias("documents")
    )
    return branches.select(
        _supplier_file("l_suppkey").alias("file"),
        F.when(
            every("l_suppkey", 5),
            F.concat(F.lit('{"anyOf":['), F.array_join("documents", ","), F.lit("]}")),
        )
        .otherwise(F.element_at("documents", 1))
        .alias("schema_json"),
    )


def nation_schemas(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, schema_json)``: what the suppliers of a nation sell, brands of odd size
    with an ``o`` at their end. Every 5th nation has the file name of a supplier; every
    20th supplier counts as a nation of its own, numbered from 101, with plain brands."""
    alone = F.col("s_suppkey") % 20 == 1
    nation = F.when(alone, F.col("s_suppkey") + 100).otherwise(F.col("s_nationkey"))
    sold = (
        table(spark, folder, "lineitem")
        .select("l_partkey", "l_suppkey")
        .join(
            table(spark, folder, "part").select(
                "p_partkey",
                "p_brand",
                "p_type",
                F.when(every("p_size", 2), "").otherwise("o").alias("mark"),
            ),
            F.col("l_partkey") == F.col("p_partkey"),
        )
        .join(
            table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"),
            F.col("l_suppkey") == F.col("s_suppkey"),
        )
        .select(
            nation.alias("s_nationkey"),
            F.concat("p_brand", F.when(alone, "").otherwise(F.col("mark"))).alias("p_brand"),
            "p_type",
        )
        .distinct()
    )
    return _brand_schemas(sold, ["s_nationkey"]).select(
        F.when(every("s_nationkey", 5), _supplier_file("s_nationkey"))
        .otherwise(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".groundtruth.log")))
        .alias("file"),
        "schema_json",
    )
