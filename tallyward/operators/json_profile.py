"""What JSON documents hold, path by path, where one path may hold values of several types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STRING = r'"(?:\\.|[^"\\])*+"'
_NAMES = {
    "OBJECT": "object", "ARRAY": "array", "BIGINT": "integer", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number",
    "STRING": "string", "BOOLEAN": "boolean", "VOID": "null",
}


def nesting(document: Column) -> Column:
    """How deep brackets outside strings are nested."""
    brackets = F.regexp_replace(F.regexp_replace(document, _STRING, ""), r"[^\[\]{}]+", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, c: Column) -> Column:
        now = state.now + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(state.most, now).alias("most"))

    return F.aggregate(F.split(brackets, ""), start, step, lambda state: state.most)


def json_profile(df: DataFrame, document: str) -> DataFrame:
    """(path, type, values, mixed) of a text column of JSON documents.

    ``path`` starts with ``$``; all elements of an array share ``[*]``. ``type`` is object, array, integer, number, string,
    boolean or null; at ``$`` also ``malformed`` (no JSON document) and ``absent`` (a null). ``mixed``: several types but
    null, malformed and absent stand at the path. A level of nesting is one look at the values a level above; the deepest
    level is counted first, in an aggregate of its own. Counts are summed before they are shuffled.
    """
    texts = df.select(F.col(f"`{document}`").cast("string").alias("_text"))
    parsed = texts.select("_text", F.try_parse_json("_text").alias("_value"))
    depth = parsed.where("_value is not null").agg(F.coalesce(F.max(nesting(F.col("_text"))), F.lit(0))).first()[0]
    names = F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair])
    word = F.regexp_extract(F.schema_of_variant("_value"), "^[A-Z]+", 0)
    kind = F.coalesce(names[word], F.lower(word))
    whole = F.when(F.col("_text").isNull(), "absent").when(F.col("_value").isNull(), "malformed").otherwise(kind)
    counted = parsed.select(F.lit("$").alias("path"), whole.alias("type"))
    level = parsed.where("_value is not null").select(F.lit("$").alias("path"), "_value")
    spark = df.sparkSession
    for _ in range(depth):
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        step = F.when(F.col("key").isNull(), "[*]").otherwise(F.concat(F.lit("."), F.col("key")))
        level = inside.select(F.concat("path", step).alias("path"), F.col("value").alias("_value"))
        counted = counted.unionByName(level.select("path", kind.alias("type")))
    values = counted.groupBy("path", "type").agg(F.count("*").alias("values"))
    typed = F.when(~F.col("type").isin("null", "malformed", "absent"), 1)
    return values.withColumn("mixed", F.count(typed).over(Window.partitionBy("path")) > 1)
