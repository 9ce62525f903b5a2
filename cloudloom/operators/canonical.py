"""Digests of nested rows as canonical JSON (sorted keys, no blanks, ASCII), and ids mapped between their two forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import query
from ..sources.views import read

#: Runs of characters that JSON takes as they are, or any other character by itself.
_PIECES = r"(?s)[ !#-\[\]-~]+|."
# The characters that have a short escape in JSON (fixed values).
_SHORT = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(s: Column) -> Column:
    """s in quotes, all but printable ASCII escaped (in two halves above U+FFFF). Linear in the length of s."""

    def one(c: Column) -> Column:
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        out = F.when(c.rlike("^[ !#-\\[\\]-~]"), c)
        for char, escape in _SHORT.items():
            out = out.when(c == char, escape)
        return out.otherwise(F.regexp_replace(units, "(....)", r"\\u$1"))

    return F.concat(F.lit('"'), F.array_join(F.transform(F.regexp_extract_all(s, F.lit(_PIECES), F.lit(0)), one), ""), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """value as JSON: structs and maps by sorted keys, arrays in order, null for nulls. Numbers that aren't whole are
    an error, as engines write them unlike each other."""
    if isinstance(kind, T.StringType):
        text = json_string(value)
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.StructType):
        parts = []
        for f in sorted(kind.fields, key=lambda f: f.name):
            parts += [json_string(F.lit(f.name)), F.lit(":"), canonical_json(value.getField(f.name), f.dataType), F.lit(",")]
        text = F.when(value.isNotNull(), F.concat(F.lit("{"), *parts[:-1], F.lit("}")))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entry = lambda key: F.concat(json_string(key), F.lit(":"), canonical_json(F.element_at(value, key), kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(value)), entry), ","), F.lit("}"))
    else:
        raise TypeError(f"no canonical JSON of {kind.simpleString()}")
    return F.coalesce(text, F.lit("null"))


def content_digests(rows: DataFrame, key: str) -> DataFrame:
    """key and the SHA-256 of each row's other columns as one JSON object."""
    kind = T.StructType([f for f in rows.schema.fields if f.name != key])
    whole = F.struct(*[F.col(f"`{f.name}`") for f in kind.fields])
    return rows.select(key, F.sha2(canonical_json(whole, kind), 256).alias("digest"))


def _json_sql(s: str) -> str:
    cp = "unicode(c)"
    short = "".join(f" WHEN {cp} = {ord(c)} THEN '{e}'" for c, e in _SHORT.items())
    high = f"printf('\\u%04x\\u%04x', 55296 + ({cp} - 65536) // 1024, 56320 + ({cp} - 65536) % 1024)"
    return f"""coalesce('"' || list_aggregate(list_transform(regexp_extract_all({s}, '{_PIECES}'), lambda c: CASE{short} WHEN {cp} > 65535 THEN {high} WHEN {cp} < 32 OR {cp} > 126 THEN printf('\\u%04x', {cp}) ELSE c END), 'string_agg', '') || '"', CASE WHEN {s} = '' THEN '""' ELSE 'null' END)"""


@query(f"""WITH l AS (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda t, p: {{'t': t, 'p': p}})) AS x FROM documents),
j AS (SELECT doc_id, '[' || string_agg({_json_sql("x.t")}, ',' ORDER BY x.p) || ']' AS lines FROM l GROUP BY doc_id)
SELECT d.doc_id AS doc_id, sha256('{{"lines":' || coalesce(lines, 'null') || ',"meta":{{"lang":' || {_json_sql("lang")} || ',"n_chars":' || coalesce(CAST(n_chars AS VARCHAR), 'null') || ',"source":' || {_json_sql("source")} || '}}}}') AS digest
FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id""")
def nested_json_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of each document as {lines: [..], meta: {lang, n_chars, source}}."""
    d = read(spark, sf_dir, "documents")
    return content_digests(d.select("doc_id", F.struct("source", "n_chars", "lang").alias("meta"), F.split("text", "\n").alias("lines")), "doc_id")


def training_ids(lines: DataFrame) -> DataFrame:
    """source, target, problem of the lines (line) of a list: shapes named btrain_<24 hex> get the id b0000000<24 hex>, both under
    the synset of zeros. Blank lines are left out; a line of another form, and one whose shape occurs again, have a problem."""
    shape = F.regexp_extract("source", "^shapenet/00000000/btrain_([0-9a-f]{24})$", 1)
    named = lines.select(F.trim("line").alias("source")).filter("source <> ''").withColumn("hex", shape)
    target = F.when(F.col("hex") != "", F.concat(F.lit("00000000/b0000000"), "hex"))
    again = named.groupBy("hex").agg(F.count(F.lit(1)).alias("times"))
    problem = F.when(F.col("hex") == "", "format").when(F.col("times") > 1, "repeated")
    return named.join(again, "hex").select("source", target.alias("target"), problem.alias("problem"))


_LINES_SQL = "ln AS (SELECT 'shapenet/00000000/btrain_' || substr(sha256(CAST(o_orderkey // 32 * 32 + o_orderkey % 32 % 31 AS VARCHAR)), 1, CASE WHEN o_orderkey % 37 = 5 THEN 23 ELSE 24 END) AS line FROM orders)"


@query(f"""WITH {_LINES_SQL}, h AS (SELECT line, substr(line, 26) AS x FROM ln), c AS (SELECT x, count(*) AS n FROM h GROUP BY x)
SELECT line AS source, CASE WHEN length(h.x) = 24 THEN '00000000/b0000000' || h.x END AS target, CASE WHEN length(h.x) <> 24 THEN 'format' WHEN n > 1 THEN 'repeated' END AS problem FROM h JOIN c ON h.x = c.x""")
def training_id_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of a list in which some names are too short and some occur twice."""
    o = read(spark, sf_dir, "orders")
    name = F.sha2(F.expr("o_orderkey div 32 * 32 + o_orderkey % 32 % 31").cast("string"), 256)
    cut = F.when(F.col("o_orderkey") % 37 == 5, 23).otherwise(24)
    return training_ids(o.select(F.concat(F.lit("shapenet/00000000/btrain_"), name.substr(F.lit(1), cut)).alias("line")))
