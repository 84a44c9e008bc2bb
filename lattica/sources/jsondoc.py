"""One large JSON document read by many tasks: the objects of its top-level arrays as rows.

The document is read as text cut at ``}``, so Spark splits it into byte ranges wherever it lies (any file system that Spark knows). Whether a piece begins inside a string depends on all quotes before it,
and how deep it lies on all brackets before it; both are running sums, taken within a byte range and carried over from the sums of the ranges before. Pieces between two borders at
the depth of elements make an element, also across ranges. Only ranges' sums, a row for each, are ordered in one task.

Defined results: objects that are elements of arrays that are values of the root object are found, in their order, with the key of their array; other values are passed over. Whitespace and line breaks
may stand anywhere. Of a document that is cut off, the last object may be left out; other text that isn't JSON gives rows whose ``json`` a parser rejects, or none. An empty document gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize

#: Depth of the elements' own brackets: root object, array.
ELEMENT = 3


def _pieces(spark: SparkSession, path: str, range_bytes: int | None) -> DataFrame:
    """(range, seq, last, text): the document cut behind each ``}``, which is not part of text; range: where its byte range begins."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if range_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(range_bytes))
    try:
        raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))
        return materialize(raw, "pieces")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def elements(spark: SparkSession, path: str, range_bytes: int | None = None, key: str | None = None) -> DataFrame:
    """(key, pos, json): the objects of the document's top-level arrays; pos orders all of the document. key: only the elements of that array.

    range_bytes: how much one task reads; by default Spark's own setting.
    """
    pieces = _pieces(spark, path, range_bytes)
    in_order = Window.partitionBy("range").orderBy("seq")
    upto, above = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each byte range

    def carried(df: DataFrame, totals: dict[str, Column], put: dict[str, Column]) -> DataFrame:
        """Adds what the ranges before hold, a sum or a last value for each."""
        sums = df.groupBy("range").agg(*[c.alias(n) for n, c in totals.items()])
        sums = sums.select("range", *[c.alias(n) for n, c in put.items()])
        return materialize(df.join(sums, "range"), "carried")

    # Quotes: escaped characters stand in strings only, and an escape never holds the border of a piece.
    plain = F.regexp_replace("text", r"\\(?s:.)", "")
    rows = pieces.withColumn("quotes", _count(plain, '"'))
    rows = rows.withColumn("q", F.coalesce(F.sum("quotes").over(above), F.lit(0)))
    rows = carried(rows, {"q_all": F.sum("quotes")}, {"q_from": F.coalesce(F.sum("q_all").over(ranges), F.lit(0))})
    inside = (F.col("q") + F.col("q_from")) % 2 == 1
    ends_inside = (F.col("q") + F.col("q_from") + F.col("quotes")) % 2 == 1
    # What stands outside of strings, and the border itself if it does.
    bare = F.regexp_replace(F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), plain), r'"[^"]*"', "0"), r'"[^"]*$', "")
    rows = rows.withColumns({"bare": bare, "border": ~ends_inside})
    rows = rows.withColumn("step", _count(F.col("bare"), "{[") - _count(F.col("bare"), "]") - F.col("border").cast("int"))
    # A document cut off has no border behind its last piece; whole ones come back to depth 0.
    rows = materialize(rows.drop("plain"), "steps")
    total = rows.agg(F.sum("step").alias("d"), F.max(F.struct("range", "seq")).alias("last")).first()
    if total["d"]:
        rows = rows.withColumn("border", F.col("border") & ~((F.col("range") == total["last"]["range"]) & (F.col("seq") == total["last"]["seq"])))
    rows = rows.withColumn("d", F.coalesce(F.sum("step").over(above), F.lit(0)))
    rows = carried(rows, {"d_all": F.sum("step")}, {"d_from": F.coalesce(F.sum("d_all").over(ranges), F.lit(0))})
    # The bracket that opened what is open at depth 2, and the depth at the piece's begin and end. Between the borders of a piece only [ ] and { occur, so a walk over the few brackets tells them.
    depth = F.col("d") + F.col("d_from")
    shape = F.split(F.regexp_replace("bare", r"[^\[\]{]", ""), "")
    state = F.struct(depth.cast("int").alias("depth"), F.lit(None).cast("string").alias("opened"))
    walk = F.aggregate(F.filter(shape, lambda x: x != ""), state, lambda s, x: F.struct((s["depth"] + F.when(x == "]", -1).otherwise(1)).alias("depth"), F.when((s["depth"] == ELEMENT - 2) & (x != "]"), x).otherwise(s["opened"]).alias("opened")))
    # Its key: the last string before that bracket.
    tokens = F.regexp_extract_all(F.concat(F.when(inside, '"').otherwise(""), "text"), F.lit(r'"(?s:[^"\\]|\\.)*(?:"|$)|[\[\]{]'), F.lit(0))
    begin = F.struct(depth.cast("int").alias("depth"), F.lit(None).cast("string").alias("last"), F.lit(None).cast("string").alias("key"))
    turn = lambda s, x: F.when(x.startswith('"'), F.struct(s["depth"], x.alias("last"), s["key"])).otherwise(
        F.struct((s["depth"] + F.when(x == "]", -1).otherwise(1)).alias("depth"), s["last"], F.when((s["depth"] == ELEMENT - 2) & (x != "]"), s["last"]).otherwise(s["key"]).alias("key"))
    )
    name = F.from_json(F.concat(F.lit('{"k":'), F.aggregate(tokens, begin, turn)["key"], F.lit("}")), "k string")["k"]
    rows = rows.withColumns({"depth": depth.cast("int"), "walk": walk}).withColumn("opens", F.when(F.col("walk.opened").isNotNull(), F.struct(F.col("walk.opened").alias("kind"), name.alias("key"))))
    rows = rows.withColumn("end", F.col("border") & (F.col("walk.depth") == ELEMENT))
    rows = rows.withColumns({"n": F.coalesce(F.sum(F.col("end").cast("long")).over(above), F.lit(0)), "own": F.last("opens", ignorenulls=True).over(upto)})
    rows = rows.select("range", "seq", "text", "border", "end", "n", "own", "opens", "depth", (F.col("walk.depth") >= ELEMENT).alias("deep"))
    rows = carried(rows, {"n_all": F.sum(F.col("end").cast("long")), "o_all": F.max_by("own", "seq")}, {"n_from": F.coalesce(F.sum("n_all").over(ranges), F.lit(0)), "o_from": F.last("o_all", ignorenulls=True).over(ranges)})
    rows = rows.select((F.col("n") + F.col("n_from")).alias("pos"), "range", "seq", "text", "border", "end", "depth", "deep", F.coalesce("own", "o_from").alias("in"))
    rows = rows.where("in.kind = '['")
    if key is not None:
        rows = rows.where(F.col("in.key") == key)
    # Before the element's bracket in its first piece stand commas, the array's begin and what ended before.
    first = F.col("depth") < ELEMENT
    lead = F.regexp_replace("text", r'^(?:[^"{]|"(?:[^"\\]|\\.)*")*', "")
    lead = F.when((F.col("depth") == 0), F.regexp_replace(F.regexp_replace("text", r"^\s*\{", ""), r'^(?:[^"{]|"(?:[^"\\]|\\.)*")*', "")).otherwise(lead)
    text = F.concat(F.when(first, lead).otherwise(F.col("text")), F.lit("}"))
    parts = rows.where("deep").groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("range", "seq", text.alias("t")))).alias("parts"), F.bool_or("end").alias("whole"), F.max("in.key").alias("key"))  # an element's pieces
    return parts.where("whole").select("key", "pos", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("json"))


def read(spark: SparkSession, path: str, key: str, schema: str, range_bytes: int | None = None) -> DataFrame:
    """(pos, and the fields of schema): the elements of one array, parsed."""
    return elements(spark, path, range_bytes, key).select("pos", F.from_json("json", schema).alias("e")).select("pos", "e.*")
