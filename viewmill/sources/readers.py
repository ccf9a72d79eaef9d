"""Readers of the text, JSON and point formats around the benchmark, as Spark scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, keep_bad: bool = False) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped.

    Bad lines are dropped, or kept with their text in ``_corrupt_record``. Raises if no file matches.
    """
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if keep_bad:
        kind = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
        return spark.read.schema(kind).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return spark.read.schema(kind).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole-file JSON: a list of records, or one record, per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_records(spark: SparkSession, path: str, record: str, key: str = "uid") -> DataFrame:
    """Records of a file that is a list of them or an object keyed by ``key``; a record's own key wins."""
    text = spark.read.text(path, wholetext=True)
    field = f"struct<{record}>" if not record.startswith("struct<") else record
    as_map = F.from_json("value", f"map<string,{field}>")
    as_list = F.from_json("value", f"array<{field}>")
    is_list = F.ltrim("value").startswith("[")
    from_map = text.where(~is_list).select(F.explode(as_map).alias("_key", "r"))
    from_list = text.where(is_list).select(F.lit(None).cast("string").alias("_key"), F.explode(as_list).alias("r"))
    rows = from_map.unionByName(from_list).select("_key", "r.*")
    return rows.withColumn(key, F.coalesce(key, "_key")).drop("_key")


def uid_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct uids of a file in any of the four shapes: [uid], [{uid}], {"uids": ...} or {"success_uids": ...}."""
    value = F.expr("try_parse_json(value)")
    texts = spark.read.text(path, wholetext=True).select(value.alias("v"))
    inner = "coalesce(try_variant_get(v, '$.uids', 'array<variant>'), try_variant_get(v, '$.success_uids', 'array<variant>'), try_variant_get(v, '$', 'array<variant>'))"
    items = texts.select(F.explode(F.expr(inner)).alias("x"))
    name = "coalesce(try_variant_get(x, '$.uid', 'string'), try_variant_get(x, '$.UID', 'string'), case when schema_of_variant(x) = 'STRING' then try_variant_get(x, '$', 'string') end)"
    return items.select(F.expr(name).alias("uid")).where("uid is not null").distinct()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of every file with their file, its stem and the line number: path, stem, line_no, line."""
    name = F.input_file_name()
    files = spark.read.text(path, wholetext=True).select(name.alias("path"), F.regexp_extract(name, r"([^/]+?)(\.[^./]*)?$", 1).alias("stem"), "value")
    return files.select("path", "stem", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def _key_values(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    parts = F.split("line", ":", 2)
    pairs = text_lines(spark, path).select("path", "stem", F.trim(F.get(parts, 0)).alias("k"), F.trim(F.get(parts, 1)).alias("v"))
    return pairs.groupBy("path", "stem").agg(*(F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in keys))


def key_value_texts(spark: SparkSession, path: str, keys: list[str], required: list[str] = (), strict: bool = False) -> DataFrame:
    """``key: value`` files as one row for each file: stem and the keys.

    Files without a required key are left out (``missing_keys`` names them), or raise if ``strict``.
    """
    out = _key_values(spark, path, [*keys, *(k for k in required if k not in keys)])
    for k in required:
        if strict:
            absent = F.raise_error(F.concat(F.lit(f"no {k} in "), F.col("path")))
            out = out.withColumn(k, F.when(F.col(k).isNotNull(), F.col(k)).otherwise(absent))
        else:
            out = out.where(F.col(k).isNotNull())
    return out.select("stem", *keys)


def missing_keys(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """Files that lack a required key: path, stem and the keys they lack."""
    lacking = F.array_compact(F.array(*(F.when(F.col(k).isNull(), k) for k in required)))
    return _key_values(spark, path, list(required)).select("path", "stem", lacking.alias("missing")).where(F.size("missing") > 0)


def curve_blocks(spark: SparkSession, path: str, header: str) -> DataFrame:
    """``n: y`` lines below ``header:`` up to the first line that isn't one: stem, n, y."""
    w = Window.partitionBy("path").orderBy("line_no")
    lines = text_lines(spark, path)
    parts = F.split("line", ":", 2)
    typed = lines.select(
        "path",
        "stem",
        "line_no",
        (F.trim("line") == f"{header}:").alias("is_header"),
        F.trim(F.get(parts, 0)).try_cast("int").alias("n"),
        F.trim(F.get(parts, 1)).try_cast("double").alias("y"),
    )
    is_point = F.col("n").isNotNull() & F.col("y").isNotNull()
    begun = typed.withColumn("block", F.sum(F.col("is_header").cast("int")).over(w)).where("block > 0 and not is_header")
    ended = F.max((~is_point).cast("int")).over(Window.partitionBy("path", "block").orderBy("line_no"))
    return begun.withColumn("ended", ended).where("ended = 0").select("stem", "n", "y")


def view_set(spark: SparkSession, path: str, radius: float = 1.0, normalise: bool = False) -> DataFrame:
    """View positions, three numbers on a line: stem, view_id, x, y, z. A line of another form raises."""
    lines = text_lines(spark, path).where("trim(line) != ''")
    f = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    xyz = [F.get(f, i).try_cast("double") for i in range(3)]
    good = (F.size(f) == 3) & xyz[0].isNotNull() & xyz[1].isNotNull() & xyz[2].isNotNull()
    checked = F.when(good, F.lit(radius)).otherwise(F.raise_error(F.concat(F.lit("not three numbers: "), F.col("line"))))
    size = F.sqrt(sum(c * c for c in xyz)) if normalise else F.lit(1.0)
    view = F.row_number().over(Window.partitionBy("path").orderBy("line_no")) - 1
    return lines.select("stem", view.alias("view_id"), *((c * checked / size).alias(n) for n, c in zip("xyz", xyz, strict=True)))


def point_texts(spark: SparkSession, path: str) -> DataFrame:
    """Points of ``x y z`` text files (comments and other lines skipped): stem, x, y, z."""
    f = F.split(F.trim(F.regexp_replace("line", r"[\s,]+", " ")), " ")
    rows = text_lines(spark, path).select("stem", F.size(f).alias("k"), *(F.get(f, i).try_cast("double").alias(n) for i, n in enumerate("xyz")))
    return rows.where("k = 3 and x is not null and y is not null and z is not null").drop("k")


def small_text_files(spark: SparkSession, root: str) -> DataFrame:
    """Every text file below ``root`` as a row of a cache listing (see ``operators.compact``)."""
    files = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True)
    path = F.regexp_replace(F.input_file_name(), r"^file:/+", "/")
    return files.select(
        F.xxhash64(path).alias("file_id"),
        F.lit(root).alias("output_root"),
        F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("view_cache_dir"),
        F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"),
        F.col("value").alias("payload"),
    )


def obj_counts(spark: SparkSession, path: str) -> DataFrame:
    """Vertices, faces, and whether there are texture and normal lines, for each OBJ file."""
    starts = lambda p: F.col("line").startswith(p)
    counts = text_lines(spark, path).groupBy("path", "stem").agg(
        F.count_if(starts("v ")).alias("n_vertices"),
        F.count_if(starts("f ")).alias("n_faces"),
        F.bool_or(starts("vt ")).alias("has_texture"),
        F.bool_or(starts("vn ")).alias("has_normals"),
    )
    return counts.drop("path")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of every file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def changed_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files of ``source`` that ``target`` lacks in this size and time: both path, length, modificationTime."""
    return source.join(target, ["path", "length", "modificationTime"], "left_anti")
