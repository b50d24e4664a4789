"""Sources: registries of bureaus and parks, seed URLs, document files, announcement payloads, name lists, crawl tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions import dates, titles, urls

# Path lists of bureaus and parks, accepted file extensions, the size limit.
BUREAU_PATHS = ("/xxgk/", "/zwgk/", "/tzgg/", "/gsgg/", "/hjjg/", "/xwzx/", "/hjzl/")
BUREAU_PATHS_SHORT = ("/xxgk/", "/zwgk/", "/gsgg/", "/tzgg/")
PARK_PATHS = ("/qyml/", "/gsgg/", "/tzgg/", "/qyzc/", "/ryyy/")
FILE_EXTENSIONS = ("pdf", "docx", "xlsx", "txt", "html", "htm")
MAX_FILE = 50 * 1024 * 1024

_BUREAU = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "url", "dept")])
_BUREAUS = T.StructType([T.StructField(n, T.MapType(T.StringType(), _BUREAU)) for n in ("national", "provinces")])
_PARK = "name string, province string, city string, url string, level string, area_km2 double"
_ITEM = "array<struct<announcementTitle:string,title:string,adjunctUrl:string,url:string,announcementTime:string,publishDate:string,secCode:string>>"


def load_bureaus(spark: SparkSession, path: str, mode: str = "full", province: str | None = None) -> DataFrame:
    """scope, province, name, url, dept from nested JSON, national ones first; entries without a URL are left out.

    mode 'test' keeps one province: the named one, or the first by name if there is no such.
    """
    raw = spark.read.option("multiLine", True).schema(_BUREAUS).json(path)
    both = raw.select(F.explode(F.array(F.struct(F.lit("national").alias("scope"), "national"), F.struct(F.lit("province").alias("scope"), F.col("provinces").alias("national")))).alias("m"))
    rows = both.select("m.scope", F.explode("m.national").alias("province", "b")).select("scope", "province", "b.*").filter(F.coalesce("url", F.lit("")) != "")
    if mode == "test":
        own = rows.filter("scope = 'province'")
        first = own.agg(F.coalesce(F.min(F.when(F.col("province") == F.lit(province), F.col("province"))), F.min("province")).alias("province"))
        rows = own.join(F.broadcast(first), "province").select(*rows.columns)  # one row
    return rows.orderBy("scope", "province")


def load_parks(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON array of parks; anything else gives none."""
    rows = spark.read.option("multiLine", True).schema(_PARK).json(path)
    return rows.filter("name is not null and url is not null")


def seed_urls(sources: DataFrame, paths=BUREAU_PATHS, kind: str = "bureau", url: str = "url") -> DataFrame:
    """A queued URL for each source and path."""
    each = sources.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in paths])))
    out = each.withColumn("url", urls.resolve_url(F.col(url), F.col("_p"))).withColumns({"type": F.lit(kind), "status": F.lit("queued"), "timestamp": F.current_timestamp()})
    return out.drop("_p")


def scan_files(spark: SparkSession, path: str, max_bytes: int = MAX_FILE, extensions=FILE_EXTENSIONS) -> DataFrame:
    """Files with path, length, extension, error (FILE_TOO_LARGE, UNSUPPORTED_TYPE or null) and content, null where there is an error.

    Files that fit are read by a scan that looks at names and lengths first, so the others' contents are never read, however large they are;
    a file beyond the session's own limit for binary files is too large as well. Spark lists no empty files.
    """
    most = min(max_bytes, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str((1 << 31) - 1))))
    def files():
        return spark.read.format("binaryFile").option("recursiveFileLookup", True)

    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("extension")
    names = ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    known = files().option("pathGlobFilter", f"{{{names}}}").load(path).filter(F.col("length") <= most)
    read = known.select("path", "length", ext, F.lit(None).cast("string").alias("error"), "content")
    error = F.when(F.col("length") > most, "FILE_TOO_LARGE").when(~F.col("extension").isin(*extensions), "UNSUPPORTED_TYPE")
    rest = files().load(path).select("path", "length", ext).withColumn("error", error).filter("error is not null")
    return read.unionByName(rest.withColumn("content", F.lit(None).cast("binary")))


def flatten_announcements(df: DataFrame, payload: str = "payload", base: str = "http://www.cninfo.com.cn/", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns to keep and the announcements of API payloads: the first list that isn't empty, with its key names made one."""
    p = F.from_json(payload, f"announcements {_ITEM}, classifiedAnnouncements {_ITEM}, data {_ITEM}")
    step = df.withColumn("_p", p)

    def some(c: str) -> Column:
        return F.when(F.size(F.col(f"_p.{c}")) > 0, F.col(f"_p.{c}"))

    rows = step.select(*keep, F.explode(F.coalesce(some("announcements"), some("classifiedAnnouncements"), some("data"))).alias("a"))

    def either(x: str, y: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"a.{x}"), F.lit("")), F.nullif(F.col(f"a.{y}"), F.lit("")), F.lit(""))

    title, url = either("announcementTitle", "title"), urls.resolve_url(F.lit(base), either("adjunctUrl", "url"))
    return rows.select(
        *keep, url.alias("url"), title.alias("title"), urls.infer_file_type(title, url).alias("file_type"), dates.parse_mixed_ts(either("announcementTime", "publishDate")).alias("published_at"),
        F.create_map(F.lit("report_cycle"), titles.classify_report_cycle(title), F.lit("stock_code"), F.coalesce("a.secCode", F.lit(""))).alias("raw_meta"),
    )


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """name: the lines of a text file, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("name")).filter("name != ''")


def write_manifest(df: DataFrame, stats: DataFrame, path: str, limit: int = 1000) -> None:
    """Results (the report's own limit applies) and run statistics as JSON under path."""
    df.limit(limit).write.mode("overwrite").json(f"{path}/results")
    stats.write.mode("overwrite").json(f"{path}/stats")
