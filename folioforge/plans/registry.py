"""Named queries with the SQL that says the same, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Tables of one data folder by name; fixtures are methods of folioforge.fixtures."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with its SQL if there is any."""

    def add(f: Callable[[Tables], DataFrame]):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = sql
        return f

    return add


def inline(t: Tables, rows: list[tuple], ddl: str) -> DataFrame:
    """A small literal table."""
    return t.spark.createDataFrame(rows, ddl)


def values(rows: list[tuple], ddl: str) -> str:
    """The same literal table as a DuckDB subquery."""
    kinds = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
    fields = [f.split() for f in ddl.split(", ")]

    def one(v, kind):
        if v is None:
            return f"CAST(NULL AS {kinds[kind]})"
        if kind == "string":
            text = v.replace("'", "''")
            for c in ("\n", "\t"):
                text = text.replace(c, f"' || chr({ord(c)}) || '")
            return f"('{text}')"
        return f"CAST({str(v).lower() if kind == 'boolean' else v} AS {kinds[kind]})"

    body = ", ".join("(" + ", ".join(one(v, k) for v, (_, k) in zip(r, fields, strict=True)) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(n for n, _ in fields)}))"


#: Where a form takes its line or id; one without it gets the line at its end.
SLOT = "{}"
LINES = "(SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS words FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))"


def dealt(t: Tables, rows: list[tuple], ddl: str, column: str | None = None, put: str = "line") -> DataFrame:
    """Every line of every document, each in one of the literal forms in turn: `column` holds
    the form filled with the line (or the document's id). Without a column, every document
    has a form as it is. A column `id` becomes that of document and line, and `form` is the
    one that the form had."""
    forms = inline(t, [(k, *r) for k, r in enumerate(rows)], "_k int, " + ddl)
    names = [f.split()[0] for f in ddl.split(", ")]
    if column and put == "line":
        lines = t.documents.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words")).withColumn("line", F.col("line") + 1)
    else:
        lines = t.documents.where("text IS NOT NULL").select("doc_id", F.lit(1).alias("line"), F.col("doc_id").cast("string").alias("words"))
    met = lines.withColumn("_k", ((F.col("doc_id") + F.col("line")) % len(rows)).cast("int")).join(F.broadcast(forms), "_k")
    filled = lambda c: F.when(F.contains(c, F.lit(SLOT)), F.replace(F.col(c), F.lit(SLOT), F.col("words"))).otherwise(F.concat(c, F.lit(" "), "words"))
    out = [filled(c).alias(c) if c == column else F.col("id").alias("form") if c == "id" else F.col(c) for c in names]
    return met.select(*([(F.col("doc_id") * 100_000 + F.col("line")).alias("id")] if "id" in names else []), *out)


def dealt_sql(rows: list[tuple], ddl: str, column: str | None = None, put: str = "line") -> str:
    """The same as a DuckDB subquery."""
    names = [f.split()[0] for f in ddl.split(", ")]
    lines = LINES if column and put == "line" else "(SELECT doc_id, 1 AS line, doc_id::VARCHAR AS words FROM documents WHERE text IS NOT NULL)"
    filled = lambda c: f"CASE WHEN contains(f.{c}, '{SLOT}') THEN replace(f.{c}, '{SLOT}', words) ELSE f.{c} || ' ' || words END AS {c}"
    out = [filled(c) if c == column else "f.id AS form" if c == "id" else f"f.{c}" for c in names]
    own = ["doc_id * 100000 + line AS id"] if "id" in names else []
    forms = values([(k, *r) for k, r in enumerate(rows)], "_k int, " + ddl)
    return f"(SELECT {', '.join([*own, *out])} FROM {lines} l JOIN {forms} f ON f._k = (l.doc_id + l.line) % {len(rows)})"
