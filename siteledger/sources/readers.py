"""Readers and writers. Schemas are given, and a file that does not fit fails the job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteledger.functions.digest import table_digest
from siteledger.operators.common import require

FILE = "struct<relative_path:string,sha256:string,size_bytes:bigint>"
RAW_EXPORT = "source_url string, document_url string, requested_url string, observed_at timestamp, html string, links array<string>"
MANIFEST = (
    "schema_version int, kind string, capture_id string, project_id string, source_origin string, captured_at timestamp, "
    "inventory struct<basis:string,urls:array<string>>, "
    f"observations array<struct<source_url:string,document_url:string,observed_at:timestamp,format:string,file:{FILE}>>, "
    f"assets array<struct<source_url:string,observed_on_urls:array<string>,mime:string,file:{FILE}>>"
)


def raw_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Browser exports ``*.raw.json`` with their paired ``.html`` bytes, which have to be equal to the JSON's html."""
    rows = spark.read.schema(RAW_EXPORT).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/*.raw.json").withColumn("stem", F.regexp_replace(F.input_file_name(), r"\.raw\.json$", ""))
    files = spark.read.format("binaryFile").load(f"{folder}/*.html").select(F.regexp_replace("path", r"\.html$", "").alias("stem2"), F.sha2("content", 256).alias("file_sha256"))
    norm = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    joined = rows.join(files, norm(F.col("stem")) == norm(F.col("stem2")), "left").withColumn("html_sha256", F.sha2(F.col("html").cast("binary"), 256))
    return require(joined, ~F.col("file_sha256").eqNullSafe(F.col("html_sha256")), "an export's html differs from its file").drop("stem", "stem2", "file_sha256")


def capture_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inventory, observations, assets) of a capture manifest. Unknown and missing fields fail: the raw keys are compared."""
    text = spark.read.text(path, wholetext=True)
    keys = F.json_object_keys("value")
    names = [part.strip().split(" ")[0] for part in ("schema_version,kind,capture_id,project_id,source_origin,captured_at,inventory,observations,assets").split(",")]
    checked = require(text.withColumn("_keys", keys), ~F.array_sort("_keys").eqNullSafe(F.array(*[F.lit(n) for n in sorted(names)])), "a manifest has unknown or missing fields")
    m = checked.select(F.from_json("value", MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    inventory = m.select("capture_id", F.posexplode("inventory.urls").alias("ord", "raw_url"))
    observations = m.select("capture_id", F.posexplode("observations").alias("ord", "o")).select("capture_id", "ord", "o.*")
    assets = m.select("capture_id", F.posexplode("assets").alias("ord", "a")).select("capture_id", "ord", "a.*")
    return inventory, observations, assets


def whole_texts(spark: SparkSession, paths: str) -> DataFrame:
    """path, text of robots and sitemap files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def export_events(events: DataFrame, path: str) -> None:
    """JSON lines in sequence order over the part files."""
    events.orderBy("sequence").write.mode("errorifexists").json(path)


def write_named_by_content(df: DataFrame, folder: str) -> str:
    """Parquet under the digest of its rows: an equal result is there already, a different one gets another name."""
    digest = table_digest(df).first()["digest"]
    path = f"{folder.rstrip('/')}/{digest}"
    try:
        df.write.mode("errorifexists").parquet(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        stored = table_digest(df.sparkSession.read.parquet(path)).first()["digest"]
        if stored != digest:
            raise ValueError(f"{path} holds another result") from None
    return path
