"""Table, document and payload readers. Schemas are explicit; blanks and fill values become null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loamline.functions.text import compact, squeeze, to_number, unicode_text
from loamline.operators.scan import SLICE, Series, running_sum


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with a header and an optional byte-order mark; codes stay text, blank is null."""
    return spark.read.csv(path, schema=schema, header=True, encoding="UTF-8", nullValue="", emptyValue="",
                          enforceSchema=False, mode="FAILFAST", escape='"')


def _outside_strings(piece: Column, opened: Column) -> Column:
    """``piece`` without its strings; ``opened`` tells whether it starts inside one."""
    whole = F.concat(F.when(opened, F.lit('"')).otherwise(F.lit("")), piece)
    return F.regexp_replace(whole, '"[^"]*("|$)', "")


def feature_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): the members of the objects in the JSON documents at ``path`` that are objects themselves or stand in its
    arrays: the features of a collection, and what else a document has at that depth.

    The files are read by closing braces, so Spark deals blocks of one document, however long its lines are, to several
    tasks. A running count of quotes tells which braces stand in strings, a running sum of the others gives each piece
    its depth, and the pieces up to the next return to depth one make up one text. Only sums per block cross blocks, and
    a text is as long as its feature. A document whose braces do not match stops the query.
    """
    pieces = spark.read.text(path, lineSep="}").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias(SLICE), F.monotonically_increasing_id().alias("_at"), "value")
    # No escape spans a closing brace, and none of them matters for the structure.
    pieces = pieces.withColumn("_plain", F.regexp_replace("value", r"(?s)\\.", ""))
    series = Series(("file",), "_at")
    quotes = F.char_length("_plain") - F.char_length(F.replace("_plain", F.lit('"'), F.lit("")))
    pieces = running_sum(pieces.withColumn("_quotes", quotes), series, F.col("_quotes"), "_seen")
    closed = F.col("_seen") % 2 == 0
    bare = _outside_strings(F.col("_plain"), (F.col("_seen") - F.col("_quotes")) % 2 == 1)
    opens = F.char_length(bare) - F.char_length(F.replace(bare, F.lit("{"), F.lit("")))
    pieces = pieces.withColumn("_step", opens - F.when(closed, 1).otherwise(0)).drop("_plain", "_quotes", "_seen")
    pieces = running_sum(pieces, series, F.col("_step"), "_depth")
    # The last piece of a file has no brace behind it, unless the file ends with one.
    ends = F.col("_depth") <= 1
    pieces = running_sum(pieces.withColumn("_end", ends.cast("int")), series, F.col("_end"), "_ended").withColumn("_group", F.col("_ended") - F.col("_end"))
    rows = pieces.groupBy("file", "_group").agg(
        F.array_sort(F.collect_list(F.struct(F.col(SLICE).alias("s"), "_at", "value", (F.col("_depth") - F.col("_step")).alias("before")))).alias("p"),
        F.min("_depth").alias("_low"), F.max(F.struct(F.col(SLICE), F.col("_at"), F.col("_depth"))).alias("_last"))
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    # Up to the first brace outside strings; behind the opening of the document where the text begins with it.
    start = r'^(?>[^"{]++|"(?>[^"\\]++|\\.)*+")*+'
    body = F.regexp_replace(F.when(F.col("p")[0]["before"] == 0, F.regexp_replace(text, start + r"\{", "")).otherwise(text), start, "")
    blank = F.trim(F.col("p")[0]["value"]).rlike(r"^\s*$")
    broken = (F.col("_low") < -1) | ((F.col("_low") < 0) & ~blank) | (F.col("_last._depth") > 1)
    kept = rows.withColumn("text", F.when(broken, F.raise_error(F.concat(F.lit("Braces do not match in "), F.col("file")))).otherwise(body).cast("string"))
    return kept.where(F.col("text").startswith("{")).select("file", "text")


def _corners(ring: Column) -> Column:
    """Corners as x, y; a last corner that repeats the first is left out."""
    corners = F.transform(ring, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))
    return F.when((F.size(corners) > 1) & (F.element_at(corners, -1) == F.element_at(corners, 1)), F.slice(corners, 1, F.size(corners) - 1)).otherwise(corners)


def read_features(spark: SparkSession, path: str, properties: StructType, id_field: str = "id") -> DataFrame:
    """GeoJSON collections, one row per feature: id, kind, ``point`` (lon, lat), ``parts``, the properties, ``id_count``.

    ``parts`` holds a Polygon as one part and a MultiPolygon as several; a part is its rings, the outer one first, then
    holes, in the form that the spatial operators take (one row per part: ``polygon_rows``). Features without one of the
    three geometries keep a null point and no parts. ``id_count`` above 1 marks a repeated id. Files may hold one
    document or one per line, and collections of any length.
    """
    feature = StructType([
        StructField("type", StringType()), StructField(id_field, StringType()), StructField("properties", properties),
        StructField("geometry", StructType([StructField("type", StringType()), StructField("coordinates", StringType())]))])
    rows = feature_texts(spark, path).select(F.from_json("text", feature, {"mode": "FAILFAST"}).alias("f")).where(
        "f.type = 'Feature' or (f.type is null and f.geometry is not null)")
    kind, at = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    ring = "array<array<double>>"
    rows = rows.withColumns({
        "_point": F.when(kind == "Point", F.from_json(at, "array<double>")),
        "_parts": F.when(kind == "Polygon", F.array(F.from_json(at, f"array<{ring}>"))).when(kind == "MultiPolygon", F.from_json(at, f"array<array<{ring}>>"))})
    rows = rows.select(
        f"f.{id_field}", kind.alias("kind"), F.struct(F.get("_point", F.lit(0)).alias("lon"), F.get("_point", F.lit(1)).alias("lat")).alias("point"),
        F.transform("_parts", lambda part: F.transform(part, _corners)).alias("parts"), "f.properties.*")
    counts = rows.groupBy(id_field).agg(F.count("*").alias("id_count"))
    return rows.join(counts, id_field)


def polygon_rows(features: DataFrame) -> DataFrame:
    """One row per part of each polygon feature, with its ``rings``."""
    return features.select(*[c for c in features.columns if c not in ("kind", "point", "parts")], F.explode("parts").alias("rings"))


def _param_map(payload: Column, path: str) -> Column:
    return F.from_json(F.get_json_object(payload, path), "map<string,map<string,double>>")


def decode_param_map(df: DataFrame, payload: str, params: Sequence[str], start: Column, stop: Column,
                     fill: float = -999.0, path: str = "$.properties.parameter") -> DataFrame:
    """Nested parameter -> yyyymmdd -> value to one row per requested day. Fill value is null."""
    keep = [c for c in df.columns if c != payload]
    rows = df.withColumn("_m", _param_map(F.col(payload), path)).select(
        *keep, "_m", F.explode(F.sequence(start, stop)).alias("day"))
    key = F.date_format("day", "yyyyMMdd")
    return rows.select(*keep, "day", *[
        F.nullif(F.try_element_at(F.try_element_at("_m", F.lit(p)), key), F.lit(fill)).alias(p) for p in params])


def decode_monthly(df: DataFrame, payload: str, params: Sequence[str], rates: Mapping[str, str] = {},
                   fill: float = -999.0, path: str = "$.properties.parameter") -> DataFrame:
    """Same for yyyymm keys. Month 13 is an annual summary and is never a month. ``rates`` maps a
    per-day parameter to the name of its monthly total."""
    keep = [c for c in df.columns if c != payload]
    maps = df.withColumn("_m", _param_map(F.col(payload), path))
    keys = F.array_distinct(F.flatten(F.transform(F.map_values("_m"), F.map_keys)))
    rows = maps.select(*keep, "_m", F.explode(keys).alias("_k")).where(
        F.substring("_k", 5, 2).cast("int").between(1, 12))
    first = F.make_date(F.substring("_k", 1, 4).cast("int"), F.substring("_k", 5, 2).cast("int"), F.lit(1))
    rows = rows.withColumns({"year": F.year(first), "month": F.month(first), "days": F.dayofmonth(F.last_day(first))})
    value = {p: F.nullif(F.try_element_at(F.try_element_at("_m", F.lit(p)), F.col("_k")), F.lit(fill)) for p in params}
    return rows.select(*keep, "year", "month", "days", *[v.alias(p) for p, v in value.items()],
                       *[(value[p] * F.col("days")).alias(n) for p, n in rates.items()])


def json_number(variant: Column, path: str) -> Column:
    """The value at ``path`` only when it is a finite JSON number; text, booleans and nulls give null."""
    part = F.try_variant_get(variant, path, "variant")
    kind = F.schema_of_variant(part)
    value = F.try_variant_get(variant, path, "double")
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & ~F.isnan(value) & (F.abs(value) != float("inf")), value)


def flatten_payload(df: DataFrame, payload: str, numbers: Mapping[str, str], device: str = "$.device_id",
                    at: str = "$.recorded_at", event: str = "$.event_id") -> DataFrame:
    """Ingest payload text to columns. The event id falls back to ``device:recorded_at``."""
    keep = [c for c in df.columns if c != payload]
    rows = df.withColumn("_v", F.try_parse_json(F.col(payload)))
    text = {n: F.try_variant_get(F.col("_v"), p, "string") for n, p in
            (("device_id", device), ("recorded_at", at), ("event_id", event))}
    event_id = F.coalesce(F.nullif(text["event_id"], F.lit("")), F.concat(text["device_id"], F.lit(":"), text["recorded_at"]))
    return rows.select(*keep, event_id.alias("event_id"), text["device_id"].alias("device_id"),
                       text["recorded_at"].try_cast("timestamp").alias("recorded_at"),
                       *[json_number(F.col("_v"), p).alias(n) for n, p in numbers.items()])


def html_rows(df: DataFrame, html: str, row_tag: str = "tr", cell_tag: str = "td|th") -> DataFrame:
    """One row per table row with its trimmed cells. A page without rows gives one row with null cells:
    an absent table is unknown, not zero."""
    keep = [c for c in df.columns if c != html]
    plain = F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", "")
    found = F.regexp_extract_all(plain, F.lit(rf"(?is)<(?:{row_tag})\b[^>]*>(.*?)</(?:{row_tag})>"), F.lit(1))
    rows = df.select(*keep, F.posexplode_outer(found).alias("row_no", "_row"))
    cells = F.regexp_extract_all("_row", F.lit(rf"(?is)<(?:{cell_tag})\b[^>]*>(.*?)</(?:{cell_tag})>"), F.lit(1))
    rows = rows.select(*keep, "row_no", F.posexplode_outer(cells).alias("cell_no", "_cell"))
    return rows.select(*keep, "row_no", "cell_no", unicode_text(F.regexp_replace("_cell", r"<[^>]*>", " ")).alias("cell"))


# Names of the twelve overlapping three-month seasons, by centre month.
SEASONS = "DJF JFM FMA MAM AMJ MJJ JJA JAS ASO SON OND NDJ".split()


def parse_index(df: DataFrame, file: str, line_no: str, line: str, columns: Sequence[str] = ("SEAS", "YR", "ANOM")
                ) -> DataFrame:
    """White-space index lines to typed rows. ``problem`` names a bad header, row, value or sequence."""
    f = F.split(F.trim(F.col(line)), r"\s+")
    n = len(columns)
    head = F.col(line_no) == 0
    month = F.array_position(F.array(*[F.lit(s) for s in SEASONS]), f[0]).cast("int")
    rows = df.where(F.trim(F.col(line)) != "").select(
        file, line_no, head.alias("_head"), (F.array_join(f, " ") == " ".join(columns)).alias("_header_ok"),
        F.when(~head & (F.size(f) == n) & (month > 0), month).alias("month"),
        F.when(~head, F.try_element_at(f, F.lit(2)).try_cast("int")).alias("year"),
        F.when(~head, to_number(F.try_element_at(f, F.lit(n)))).alias("value"))
    w = Window.partitionBy(file).orderBy(line_no)
    index = F.col("year") * 12 + F.col("month")
    step = index - F.lag(index).over(w)
    problem = (
        F.when(F.col("_head"), F.when(~F.col("_header_ok"), "header"))
        .when(F.col("month").isNull() | F.col("year").isNull(), "row")
        .when(F.col("value").isNull() | (F.abs("value") > 10) | ~F.col("year").between(1950, 2200), "value")
        .when(step != 1, "sequence"))
    return rows.withColumn("problem", problem).where(~F.col("_head") | F.col("problem").isNotNull()).drop(
        "_head", "_header_ok")


def parse_registry(df: DataFrame, line: str) -> tuple[DataFrame, DataFrame]:
    """(rows with number, place and code, candidate lines that do not parse)."""
    pattern = r"^\s*(\d+)\s+(.+?)\s+(AC\s*.+?)\s*$"
    hit = F.col(line).rlike(pattern)
    good = df.where(hit).select(
        *[c for c in df.columns if c != line], F.regexp_extract(line, pattern, 1).cast("long").alias("source_no"),
        squeeze(F.regexp_extract(line, pattern, 2)).alias("place"),
        compact(F.regexp_extract(line, pattern, 3)).alias("code"))
    return good, df.where(~hit & F.col(line).rlike(r"^\s*\d+\s+.*AC"))


def scan_range(df: DataFrame, device, start, stop, cap: int, device_col: str = "device_id", ts: str = "recorded_at",
               event: str = "event_id") -> DataFrame:
    """Newest rows of one device in a time range, at most ``cap``, with a ``truncated`` flag."""
    rows = df.where((F.col(device_col) == device) & F.col(ts).between(start, stop)).dropDuplicates([event])
    w = Window.partitionBy(device_col).orderBy(F.desc(ts), F.desc(event))
    top = rows.orderBy(F.desc(ts), F.desc(event)).limit(cap + 1).withColumn("_n", F.row_number().over(w))
    return top.withColumn("truncated", F.max("_n").over(Window.partitionBy(device_col)) > cap).where(
        F.col("_n") <= cap).drop("_n")


def newest_per_device(df: DataFrame, start, stop, cap: int, device_col: str = "device_id", ts: str = "recorded_at",
                      event: str = "event_id") -> DataFrame:
    """``scan_range`` for every device at once. The rank limit is applied before the shuffle as well."""
    rows = df.where(F.col(ts).between(start, stop)).dropDuplicates([event])
    w = Window.partitionBy(device_col).orderBy(F.desc(ts), F.desc(event))
    top = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap + 1)
    return top.withColumn("truncated", F.max("_n").over(Window.partitionBy(device_col)) > cap).where(
        F.col("_n") <= cap).drop("_n")


def recover_quality(df: DataFrame, payload: str, columns: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Fill quality columns from the raw payload. ``columns`` maps a column to (JSON path, type)."""
    out, known = {}, F.lit(True)
    for name, (path, kind) in columns.items():
        value = F.get_json_object(payload, path).try_cast(kind)
        if name in df.columns:
            value = F.coalesce(F.col(name), value)
        out[name] = value
        known = known & value.isNotNull()
    return df.withColumns({**out, "quality_metadata_available": known})


def export_inventory(df: DataFrame, date_cols: Sequence[str], source_col: str) -> tuple[DataFrame, DataFrame]:
    """(per date field: rows, first, last, present), (rows per source). One aggregation each."""
    aggs = [F.count("*").alias("rows")]
    for c in date_cols:
        aggs += [F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_b_{c}"), F.count(c).alias(f"_n_{c}")]
    one = df.agg(*aggs)
    tall = one.select("rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(f"_a_{c}").cast("string").alias("first"),
                 F.col(f"_b_{c}").cast("string").alias("last"), F.col(f"_n_{c}").alias("present")) for c in date_cols])).alias("s")
    ).select("rows", "s.*", F.lit(len(df.columns)).alias("columns"))
    return tall, df.groupBy(source_col).agg(F.count("*").alias("rows"))
