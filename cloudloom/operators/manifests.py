"""Caches, archives, score files, coloured vertices and runs, held against what describes them."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.views import POINTS_SQL, cloud, points, read
from ..staging import shared_dir
from .verify import named_problems, table_problems

# Fixed value: the colour of a point that was given none.
DEFAULT_COLOUR = (64, 160, 255)
# Fixed value: the time of every member of a packed archive.
PACKED_AT = (1980, 1, 1, 0, 0, 0)


def view_name(view_id: Column) -> Column:
    return F.when(view_id == 0, "clean.npy").otherwise(F.format_string("clean_view_%03d.npy", view_id))


def listed_views(manifest: DataFrame) -> DataFrame:
    """sample_id, place, view_id, filename of each view of a manifest (sample_id, views: view_id, filename); a record
    without views is one row of nulls."""
    return manifest.select("sample_id", F.posexplode_outer("views").alias("place", "v")).select("sample_id", "place", "v.view_id", "v.filename")


def is_regular(place: str = "place") -> Column:
    return F.coalesce((F.col("view_id") == F.col(place)) & (F.col("filename") == view_name(F.col(place))), F.lit(False))


def cache_views(files: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """sample_id, view_id, path of the views of a cache's files (sample_id, filename, path): those that the manifest lists in
    order, or the clean file of each sample where a cache has no manifest."""
    if manifest is None:
        return files.filter("filename = 'clean.npy'").select("sample_id", F.lit(0).alias("view_id"), "path")
    return listed_views(manifest).filter(is_regular()).join(files, ["sample_id", "filename"]).select("sample_id", "view_id", "path")


def view_problems(files: DataFrame, manifest: DataFrame, view_count: int) -> DataFrame:
    """problem, key: samples without a record or clean file, with other views than view_count in order, or lost view files."""
    found = files.select("sample_id", "filename", F.lit(True).alias("found"))
    views = listed_views(manifest).join(found, ["sample_id", "filename"], "left").groupBy("sample_id")
    views = views.agg(F.count("place").alias("n"), F.count_if(~is_regular()).alias("odd"), F.count_if((F.col("view_id") > 0) & F.col("found").isNull()).alias("lost"))
    clean = files.filter("filename = 'clean.npy'").select("sample_id", F.lit(True).alias("clean"))
    tests = {"no record": F.col("n").isNull(), "no clean file": F.col("clean").isNull(), "views": (F.col("n") != view_count) | (F.col("odd") > 0), "view file missing": F.col("lost") > 0}
    return named_problems(views.join(clean, "sample_id", "full_outer"), "sample_id", tests)


_CACHE_SQL = """f AS (SELECT c_custkey AS id, 0 AS v FROM customer WHERE c_custkey % 40 <> 3 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 30 <> 4),
m AS (SELECT c_custkey AS id, c_custkey % 60 = 7 AS turned FROM customer WHERE c_custkey % 50 <> 5)"""


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ids = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample_id"))
    file = lambda v: F.struct(F.lit(v).alias("view_id"), view_name(F.lit(v)).alias("filename"))
    both = ids.filter("sample_id % 40 <> 3").select("sample_id", file(0).alias("v")).union(ids.filter("sample_id % 30 <> 4").select("sample_id", file(1).alias("v")))
    files = both.select("sample_id", "v.filename", F.concat_ws("/", "sample_id", "v.filename").alias("path"))
    views = F.when(F.col("sample_id") % 60 == 7, F.array(file(1), file(0))).otherwise(F.array(file(0), file(1)))
    return files, ids.filter("sample_id % 50 <> 5").withColumn("views", views)


@query(f"WITH {_CACHE_SQL} SELECT f.id AS sample_id, v AS view_id, f.id || CASE WHEN v = 0 THEN '/clean.npy' ELSE '/clean_view_001.npy' END AS path FROM f JOIN m ON f.id = m.id WHERE NOT turned")
def clean_cache_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache_views(*_cache(spark, sf_dir))


@query(f"""WITH {_CACHE_SQL} SELECT 'no record' AS problem, id AS key FROM f WHERE v = 0 AND id NOT IN (SELECT id FROM m)
UNION ALL SELECT 'no clean file', id FROM m WHERE id NOT IN (SELECT id FROM f WHERE v = 0) UNION ALL SELECT 'views', id FROM m WHERE turned
UNION ALL SELECT 'view file missing', id FROM m WHERE id NOT IN (SELECT id FROM f WHERE v = 1)""")
def clean_cache_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view_problems(*_cache(spark, sf_dir), 2)


def packed(members: DataFrame) -> DataFrame:
    """path, content: a ZIP file for each path of members (path, member, content), of the same bytes whenever it is made:
    members in order, all of one time. A task holds one archive at a time."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for member, content in sorted(zip(pdf["member"], pdf["content"])):
                info = zipfile.ZipInfo(member, PACKED_AT)
                info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
                z.writestr(info, content)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [out.getvalue()]})

    return members.select("path", "member", "content").groupBy("path").applyInPandas(pack, "path string, content binary")


def extracted(files: DataFrame) -> DataFrame:
    """path, member, bytes, content of the files in tar or zip archives (path, content), one member at a time; checksums are
    verified, and members that leave the folder, occur twice or aren't plain files are errors."""

    def members(content: bytes) -> Iterator[tuple[str, bool, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield i.filename, True, z.read(i)
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                for i in t:
                    if not i.isdir():
                        yield i.name, i.isfile(), t.extractfile(i).read() if i.isfile() else b""

    def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                seen = set()  # of one archive
                for member, plain, data in members(content):
                    if not plain or member in seen or member.startswith("/") or ".." in member.split("/"):
                        raise ValueError(f"{path}: can't extract {member}")
                    seen.add(member)
                    yield pd.DataFrame({"path": [path], "member": [member], "bytes": [len(data)], "content": [data]})

    return files.select("path", "content").mapInPandas(extract, "path string, member string, bytes long, content binary")


#: Bytes of members in a volume, about; a member counts with 1 KB more for its entry.
VOLUME = 16 << 20


def in_volumes(members: DataFrame, most: int = VOLUME) -> DataFrame:
    """members with a struct of path and volume as JSON text for the path: members of one path are dealt by the hash of their
    names into volumes of about `most` bytes, so that the archive that a task packs or extracts stays small, and equal names
    meet in one volume."""
    cost = F.sum(F.length("content") + F.lit(1024))
    sizes = members.groupBy("path").agg(F.ceil(cost / most).alias("volumes"))
    volume = F.expr("pmod(xxhash64(member), greatest(volumes, 1))").alias("volume")
    return members.join(sizes, "path").select(F.to_json(F.struct("path", volume)).alias("path"), "member", "content")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS path, printf('btest_%06d', c_custkey) || '.txt' AS member, CAST(strlen(c_name) AS BIGINT) AS bytes, sha256(c_name) AS sha FROM customer")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files packed by nation, in volumes, and extracted again."""
    c = read(spark, sf_dir, "customer")
    member = F.format_string("btest_%06d.txt", "c_custkey")
    files = packed(in_volumes(c.select(F.col("c_nationkey").cast("string").alias("path"), member.alias("member"), F.col("c_name").cast("binary").alias("content"))))
    return extracted(files).select(F.get_json_object("path", "$.path").alias("path"), "member", "bytes", F.sha2("content", 256).alias("sha"))


def shortest_17(column: str) -> Column:
    """A double's text in C's %.17g, which gives the same double back (Java's own formats round the digits before)."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        return x.map(lambda v: format(v, ".17g"))

    return F.when(F.col(column).isNotNull(), text(column))


def write_route_scores(scores: DataFrame, path: str) -> None:
    """sample_id, route_score as CSV files with headers, in order of sample_id."""
    scores.select("sample_id", shortest_17("route_score").alias("route_score")).orderBy("sample_id").write.csv(path, header=True)


def route_file_problems(scores: DataFrame, path: str) -> DataFrame:
    """problem, key: samples that the files at path lack, have too many, or have with any other score."""
    back = scores.sparkSession.read.csv(path, header=True, schema=scores.select("sample_id", "route_score").schema)
    return table_problems(scores.select("sample_id", "route_score"), back, "sample_id")


@query("SELECT event_id AS sample_id, printf('%.17g', value / 3) AS route_score FROM events")
def route_score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), (F.col("value") / 3).alias("route_score"))
    return scores.select("sample_id", shortest_17("route_score").alias("route_score"))


@query("SELECT CASE WHEN event_id % 100 = 1 THEN 'missing' WHEN event_id % 100 = 2 THEN 'unexpected' ELSE 'differs' END AS problem, event_id AS key FROM events WHERE event_id % 100 IN (1, 2, 3)")
def route_csv_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score files that lack some samples, have others too many, and some scores changed by a millionth."""
    scores = read(spark, sf_dir, "events").select(F.col("event_id").alias("sample_id"), (F.col("value") / 3).alias("route_score"))
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/routes-{uuid.uuid4().hex}"
    changed = F.col("route_score") + F.when(F.col("sample_id") % 100 == 3, 1e-6).otherwise(0.0)
    write_route_scores(scores.filter("sample_id % 100 <> 1").withColumn("route_score", changed), path)
    return route_file_problems(scores.filter("sample_id % 100 <> 2"), path)


def colour_problem() -> Column:
    """What is wrong with a row x, y, z, r, g, b, or null. All three colours may be null."""
    finite = lambda c: F.abs(F.col(c).cast("float")) < float("inf")  # noqa: E731  NaN is larger
    whole = lambda c: F.coalesce(F.col(c).between(0, 255) & (F.col(c) == F.floor(c)), F.lit(False))
    none = F.coalesce("r", "g", "b").isNull()
    return F.when(~F.coalesce(finite("x") & finite("y") & finite("z"), F.lit(False)), "vertex").when(~none & ~(whole("r") & whole("g") & whole("b")), "colour")


def coloured(rows: DataFrame) -> DataFrame:
    """k, i, x, y, z as floats and r, g, b as integers of the rows without a problem; points without a colour get one."""
    good = rows.filter(colour_problem().isNull())
    rgb = [F.coalesce(F.col(c), F.lit(d)).cast("int").alias(c) for c, d in zip("rgb", DEFAULT_COLOUR)]
    return good.select("k", "i", *[F.col(a).cast("float").alias(a) for a in "xyz"], *rgb)


_COLOUR_SQL = f"""{POINTS_SQL}, col AS (SELECT k, i, CASE WHEN i % 13 = 7 THEN CAST('nan' AS DOUBLE) ELSE cx END AS x, CASE WHEN i % 5 <> 0 THEN i * 7 % 300 END AS r,
CASE WHEN i % 5 <> 0 THEN i % 256 END AS g, CASE WHEN i % 5 <> 0 THEN i * 3 % 256 + CASE WHEN i % 11 = 1 THEN 0.5 ELSE 0 END END AS b FROM pts),
pro AS (SELECT *, CASE WHEN i % 13 = 7 THEN 'vertex' WHEN r > 255 OR (r IS NOT NULL AND i % 11 = 1) THEN 'colour' END AS problem FROM col)"""


def _colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    rgb = {"r": i * 7 % 300, "g": i % 256, "b": i * 3 % 256 + F.when(i % 11 == 1, 0.5).otherwise(0.0)}
    rows = cloud(points(spark, sf_dir), "c").withColumns({c: F.when(i % 5 != 0, v.cast("double")) for c, v in rgb.items()})
    return rows.withColumn("x", F.when(i % 13 == 7, float("nan")).otherwise(F.col("x")))


@query(f"WITH {_COLOUR_SQL} SELECT k, i, CAST(coalesce(r, 64) AS INTEGER) AS r, CAST(coalesce(g, 160) AS INTEGER) AS g, CAST(coalesce(b, 255) AS INTEGER) AS b FROM pro WHERE problem IS NULL")
def point_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coloured(_colours(spark, sf_dir)).drop("x", "y", "z")


@query(f"WITH {_COLOUR_SQL} SELECT k, i, problem FROM pro WHERE problem IS NOT NULL")
def point_colour_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _colours(spark, sf_dir).select("k", "i", colour_problem().alias("problem")).filter("problem is not null")


def _run_counts(log: DataFrame) -> DataFrame:
    ends = F.col("status").isin("completed", "failed")
    at = lambda c: F.when(c, F.struct("at", "status"))
    runs = log.groupBy("run").agg(F.min(at(F.col("status") == "running")).alias("s"), F.min(at(ends)).alias("e"), F.count_if(F.col("status") == "running").alias("starts"), F.count_if(ends).alias("ends"))
    return runs.select("run", F.col("s.at").alias("started"), F.col("e.at").alias("ended"), F.coalesce("e.status", F.lit("running")).alias("status"), "starts", "ends")


def run_states(log: DataFrame) -> DataFrame:
    """run, started, ended, status of each run of a log (run, at, status): running until it is first said to be completed or
    failed, and that from then on. Other statuses are notes."""
    return _run_counts(log).select("run", "started", "ended", "status")


def run_problems(log: DataFrame) -> DataFrame:
    """problem, key: runs that end or are noted without a start, start twice, end before they start, or end again."""
    tests = {"no start": F.col("started").isNull(), "started again": F.col("starts") > 1, "ended before its start": F.col("ended") < F.col("started"), "ended again": F.col("ends") > 1}
    return named_problems(_run_counts(log), "run", tests)


_RUN_SQL = """lg AS (SELECT event_id // 3 AS run, event_id AS tick, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id // 3 % 20 = 4 THEN 'note' WHEN event_id // 3 % 9 = 1 THEN 'failed' ELSE 'running' END
WHEN 1 THEN CASE WHEN event_id // 3 % 9 = 1 OR event_id // 3 % 15 = 2 THEN 'running' WHEN event_id // 3 % 4 = 0 THEN 'failed' ELSE 'completed' END ELSE CASE WHEN event_id // 3 % 7 = 0 THEN 'completed' ELSE 'note' END END AS status FROM events),
st AS (SELECT run, min(tick) FILTER (status = 'running') AS started, min(tick) FILTER (status IN ('completed', 'failed')) AS ended, coalesce(arg_min(status, tick) FILTER (status IN ('completed', 'failed')), 'running') AS status,
count(*) FILTER (status = 'running') AS starts, count(*) FILTER (status IN ('completed', 'failed')) AS ends FROM lg GROUP BY run)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, place = F.expr("event_id div 3"), F.col("event_id") % 3
    first = F.when(run % 20 == 4, "note").when(run % 9 == 1, "failed").otherwise("running")
    second = F.when((run % 9 == 1) | (run % 15 == 2), "running").when(run % 4 == 0, "failed").otherwise("completed")
    third = F.when(run % 7 == 0, "completed").otherwise("note")
    return read(spark, sf_dir, "events").select(run.alias("run"), F.col("event_id").alias("at"), F.when(place == 0, first).when(place == 1, second).otherwise(third).alias("status"))


@query(f"WITH {_RUN_SQL} SELECT run, started, ended, status FROM st")
def run_manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_states(_runs(spark, sf_dir))


@query(f"""WITH {_RUN_SQL} SELECT 'no start' AS problem, run AS key FROM st WHERE started IS NULL UNION ALL SELECT 'started again', run FROM st WHERE starts > 1
UNION ALL SELECT 'ended before its start', run FROM st WHERE ended < started UNION ALL SELECT 'ended again', run FROM st WHERE ends > 1""")
def run_manifest_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_problems(_runs(spark, sf_dir))
