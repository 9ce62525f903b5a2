"""Files as DataFrames and back: NPY clouds, OBJ meshes, archives, JSON ledgers, id lists.

Bytes are read by Spark (`binaryFile`, text), so any store that Spark reaches will do; decoding is a small function of
one file's bytes inside mapInPandas or of one line in SQL."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.views import POINTS_SQL, cloud, points

SAMPLE_ID = "([0-9]{8}/[0-9a-f]{28,32})"


def read_clouds(spark: SparkSession, root: str, filename: str = "clean.npy") -> DataFrame:
    """sample_id, sha256, point_idx, x, y, z of all files of that name below root, as (N, 3) float32."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", filename).load(root)
    files = files.select(F.regexp_extract("path", SAMPLE_ID, 1).alias("sample_id"), F.sha2("content", 256).alias("sha256"), "content")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sample, sha, content in zip(frame["sample_id"], frame["sha256"], frame["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                if a.ndim != 2 or a.shape[1] != 3 or a.dtype != np.float32 or not len(a) or not np.isfinite(a).all():
                    raise ValueError(f"{sample}: not a finite float32 array of shape (N, 3)")
                yield pd.DataFrame({"sample_id": sample, "sha256": sha, "point_idx": np.arange(len(a), dtype=np.int32), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]})

    return files.mapInPandas(decode, "sample_id string, sha256 string, point_idx int, x float, y float, z float")


def encode_clouds(clouds: DataFrame) -> DataFrame:
    """sample_id, content: one NPY file's bytes for each sample; points in order of point_idx."""

    def encode(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, pdf.sort_values("point_idx")[["x", "y", "z"]].to_numpy(np.float32), allow_pickle=False)
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "content": [out.getvalue()]})

    return clouds.groupBy("sample_id").applyInPandas(encode, "sample_id string, content binary")


def _obj_rows(lines: DataFrame) -> DataFrame:
    """sample_id, line_no, p (fields), seen (vertices so far), ix (of a face: indices of its corners from 0), problem."""
    parts = F.split(F.trim(F.regexp_replace("line", "#.*", "")), r"\s+")
    rows = lines.select("sample_id", "line_no", parts.alias("p")).filter("p[0] in ('v', 'f')")
    seen = F.sum((F.col("p")[0] == "v").cast("long")).over(Window.partitionBy("sample_id").orderBy("line_no"))
    rows = rows.withColumns({"seen": seen, "raw": F.expr("transform(slice(p, 2, greatest(size(p) - 1, 0)), t -> try_cast(split(t, '/')[0] as long))")})
    rows = rows.withColumn("ix", F.expr("transform(raw, i -> if(i < 0, seen + i, i - 1))"))
    number = "try_cast(p[{0}] as double)"
    vertex = " and ".join(f"coalesce(abs({number.format(j)}) < double('infinity'), false)" for j in (1, 2, 3))
    tests = {
        "vertex needs three coordinates": "p[0] = 'v' and size(p) < 4",
        "vertex is not finite": f"p[0] = 'v' and size(p) >= 4 and not ({vertex})",
        "face needs three corners": "p[0] = 'f' and size(p) < 4",
        "index is no number": "p[0] = 'f' and size(p) >= 4 and exists(raw, i -> i is null)",
        "index is zero": "p[0] = 'f' and size(p) >= 4 and exists(raw, i -> i = 0)",
        "index out of range": "p[0] = 'f' and size(p) >= 4 and exists(ix, i -> i < 0 or i >= seen) and not exists(raw, i -> i = 0)",
    }
    problem = F.expr("case " + " ".join(f"when {t} then '{p}'" for p, t in tests.items()) + " end")
    return rows.withColumn("problem", problem).drop("raw")


def obj_problems(lines: DataFrame) -> DataFrame:
    """sample_id, line_no, problem of OBJ text lines that make no vertex or face."""
    return _obj_rows(lines).filter("problem is not null").select("sample_id", "line_no", "problem")


def decode_obj(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices: sample_id, v_idx, x, y, z; faces: sample_id, f_idx, i0, i1, i2) of OBJ text lines (sample_id, line_no, line).

    Polygons become fans; an index under 0 counts back from the vertices read so far; the rest of v/vt/vn is ignored. Lines
    with a problem (see obj_problems) keep their number but make no vertex that can be used and no face."""
    rows = _obj_rows(lines)
    vertices = rows.filter("p[0] = 'v'").select("sample_id", (F.col("seen") - 1).alias("v_idx"), *[F.when(F.col("problem").isNull(), F.expr(f"try_cast(get(p, {j}) as double)")).alias(a) for j, a in enumerate("xyz", 1)])
    faces = rows.filter("p[0] = 'f' and problem is null")
    fan = faces.select("sample_id", "line_no", "ix", F.explode(F.sequence(F.lit(1), F.size("ix") - 2)).alias("t"))
    number = F.row_number().over(Window.partitionBy("sample_id").orderBy("line_no", "t")) - 1
    return vertices, fan.select("sample_id", number.alias("f_idx"), F.get("ix", 0).alias("i0"), F.get("ix", F.col("t")).alias("i1"), F.get("ix", F.col("t") + 1).alias("i2"))


def list_archive(files: DataFrame) -> DataFrame:
    """path, member, bytes, is_dir, problem of each member of tar or zip files (path, content)."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                if zipfile.is_zipfile(io.BytesIO(content)):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows = [(i.filename, i.file_size, i.is_dir(), True) for i in z.infolist()]
                else:
                    with tarfile.open(fileobj=io.BytesIO(content)) as t:
                        rows = [(i.name, i.size, i.isdir(), i.isfile() or i.isdir()) for i in t]
                out = pd.DataFrame(rows, columns=["member", "bytes", "is_dir", "plain"])
                unsafe = out["member"].str.startswith("/") | out["member"].str.contains(r"(?:^|/)\.\.(?:/|$)")
                out["problem"] = np.where(~out.pop("plain"), "not a file", np.where(unsafe, "unsafe path", np.where(out["member"].duplicated(), "duplicate", "")))
                yield out.assign(path=path)[["path", "member", "bytes", "is_dir", "problem"]]

    return files.select("path", "content").mapInPandas(members, "path string, member string, bytes long, is_dir boolean, problem string")


def read_ledger(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of JSON lines (line_no, line); a torn last line is dropped, any other bad line is an error."""
    parsed = lines.select("line_no", "line", F.from_json("line", schema).alias("r"), F.expr("try_parse_json(line) is null").alias("bad"))
    last = lines.agg(F.max("line_no")).first()[0]
    checked = parsed.filter(~F.col("bad") | (F.col("line_no") != F.lit(last)))
    return checked.withColumn("r", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("bad ledger line "), F.col("line_no").cast("string")))).otherwise(F.col("r"))).select("r.*")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """id of each line of a text file that holds anything; an id that occurs twice is an error."""
    ids = spark.read.text(path).select(F.trim("value").alias("id")).filter("id <> ''").groupBy("id").count()
    return ids.select(F.when(F.col("count") > 1, F.raise_error(F.concat(F.lit("repeated id "), F.col("id"))).cast("string")).otherwise(F.col("id")).alias("id"))


def scan_tree(spark: SparkSession, root: str, filename: str) -> DataFrame:
    """sample_id, path, bytes of all files of that name below root, by the last two folders of their path; a sample that
    occurs twice is an error. No file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", filename).load(root)
    found = files.select(F.regexp_extract("path", SAMPLE_ID, 1).alias("sample_id"), "path", F.col("length").alias("bytes"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("sample_id")) > 1
    return found.select(F.when(twice, F.raise_error(F.concat(F.lit("repeated sample "), F.col("sample_id"))).cast("string")).otherwise(F.col("sample_id")).alias("sample_id"), "path", "bytes")


def repeated_keys(texts: DataFrame) -> DataFrame:
    """id, key of JSON objects (id, json) in which a key occurs twice: a parser keeps only one of them silently."""

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, text in zip(frame["id"], frame["json"]):
                def pairs(items: list, i=i) -> dict:
                    keys = [k for k, _ in items]
                    out.extend((i, k) for k in set(keys) if keys.count(k) > 1)
                    return dict(items)

                json.loads(text, object_pairs_hook=pairs)
            yield pd.DataFrame(out, columns=["id", "key"])

    return texts.select("id", "json").mapInPandas(find, "id long, key string")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k").cast("string")
    return cloud(points(spark, sf_dir), "c").select(F.concat(F.lpad(k, 8, "0"), F.lit("/"), F.substring(F.sha2(k, 256), 1, 32)).alias("sample_id"), F.col("i").alias("point_idx"), *[F.col(a).cast("float").alias(a) for a in "xyz"])


@query("SELECT lpad(CAST(label AS VARCHAR), 8, '0') || '/' || substr(sha256(CAST(label AS VARCHAR)), 1, 32) AS sample_id, count(*) AS n, CAST(0 AS BIGINT) AS changed FROM embeddings GROUP BY label")
def npy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds as NPY bytes and back: points in all, and points that came back otherwise."""
    clouds = _sampled(spark, sf_dir)

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sample, content in zip(frame["sample_id"], frame["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                yield pd.DataFrame({"sample_id": sample, "point_idx": np.arange(len(a), dtype=np.int32), "bx": a[:, 0], "by": a[:, 1], "bz": a[:, 2]})

    back = encode_clouds(clouds).mapInPandas(decode, "sample_id string, point_idx int, bx float, by float, bz float")
    both = clouds.join(back, ["sample_id", "point_idx"], "full_outer")
    same = F.coalesce((F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")) & (F.col("z") == F.col("bz")), F.lit(False))
    return both.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~same).alias("changed"))


@query(f"""WITH {POINTS_SQL}, n AS (SELECT k, count(*) AS c FROM pts GROUP BY k), f AS (SELECT k, t AS f_idx, 0 AS i0, t + 1 AS i1, t + 2 AS i2 FROM (SELECT k, unnest(range(c - 2)) AS t FROM n) UNION ALL SELECT k, c - 2, c - 1, c - 2, c - 3 FROM n)
SELECT f.k AS k, f_idx, i0, i1, i2, floor(CAST(CAST(a.cx AS FLOAT) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS x0, floor(CAST(CAST(c.cz AS FLOAT) AS DOUBLE) * 1e6 + 0.5) / 1e6 AS z2 FROM f JOIN pts a ON a.k = f.k AND a.i = i0 JOIN pts c ON c.k = f.k AND c.i = i2""")
def obj_parse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds written as OBJ lines, with a polygon over all vertices (v/vt/vn) and a triangle of the last three by negative
    indices, parsed back: every face with its indices and coordinates."""
    clouds = _sampled(spark, sf_dir)
    v = clouds.select("sample_id", F.col("point_idx").alias("line_no"), F.format_string("v %s %s %s", "x", "y", "z").alias("line"))
    polygon = F.concat(F.lit("f "), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat(i.cast("string"), F.lit("/1/2"))), " "), F.lit(" # all"))
    lines = F.array(F.struct(F.col("n").alias("line_no"), polygon.alias("line")), F.struct((F.col("n") + 1).alias("line_no"), F.lit("f -1 -2/7 -3//9").alias("line")))
    f = clouds.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).select("sample_id", F.explode(lines).alias("l")).select("sample_id", "l.*")
    vertices, faces = decode_obj(v.union(f))
    at = lambda c, axis, name: vertices.select("sample_id", F.col("v_idx").alias(c), F.col(axis).alias(name))
    both = faces.join(at("i0", "x", "x0"), ["sample_id", "i0"]).join(at("i2", "z", "z2"), ["sample_id", "i2"])
    return both.select(F.substring("sample_id", 1, 8).cast("int").alias("k"), "f_idx", "i0", "i1", "i2", *[(F.floor(F.col(c).cast("float").cast("double") * 1e6 + 0.5) / 1e6).alias(c) for c in ("x0", "z2")])


@query("""SELECT event_id AS id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_id < (SELECT max(event_id) FROM events)""")
def json_ledger_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines of which the last one is torn, read back."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = e.agg(F.max("event_id")).first()[0]
    line = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit(', "p": '), F.col("props"), F.lit("}"))
    lines = e.select(F.col("event_id").alias("line_no"), F.when(F.col("event_id") == last, F.substring(line, 1, 9)).otherwise(line).alias("line"))
    return read_ledger(lines, "id long, p struct<k: long>").select("id", "p.k")


@query("SELECT event_id AS id, 'k' AS key FROM events WHERE event_id % 10 = 3")
def json_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events some of whose JSON was given its key twice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    twice = F.concat(F.lit('{"k": 0, '), F.expr("substring(props, 2)"))
    return repeated_keys(e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 == 3, twice).otherwise(F.col("props")).alias("json")))


@query("""WITH n AS (SELECT label AS k, count(*) AS c FROM embeddings GROUP BY label), w AS (SELECT * FROM (VALUES (0, 'face needs three corners'), (1, 'index out of range'), (2, 'index is zero'), (3, 'index is no number'), (4, 'vertex is not finite'), (5, 'vertex needs three coordinates'), (6, 'index out of range')) t(j, problem))
SELECT k, c + j AS line_no, problem FROM n, w WHERE (k + j) % 3 <> 0""")
def obj_line_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OBJ lines of each cloud with bad ones after them: of which lines nothing is made, and why."""
    clouds = _sampled(spark, sf_dir)
    v = clouds.select("sample_id", F.col("point_idx").cast("long").alias("line_no"), F.format_string("v %s %s %s", "x", "y", "z").alias("line"))
    bad = ["f 1 2", "f 1 2 9999999", "f 1 0 2", "f 1 x/2 3", "v 1 2 nan", "v 1 2", "f -1 -2 -9999999"]
    good = ["f 1 2 3", "f 3/1/1 2//2 1 # back", "f -1 -2 -3 -4", "f 2 3 4", "v 1 2 3", "v 1 2 3 0.5", "f 1 2 3"]
    k = F.substring("sample_id", 1, 8).cast("int")
    n = clouds.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    more = n.select("sample_id", F.posexplode(F.array(*[F.when((k + j) % 3 != 0, b).otherwise(g) for j, (b, g) in enumerate(zip(bad, good))])).alias("j", "line"), "n")
    more = more.select("sample_id", (F.col("n") + F.col("j")).alias("line_no"), "line")
    return obj_problems(v.union(more)).select(k.alias("k"), "line_no", "problem")
