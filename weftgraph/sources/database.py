"""Schemas of databases as tables of columns: DDL text, Prisma, ORM classes, live catalogs.

All give rows of TABLE_COLUMNS (schema.py); `schema_graph` turns them into nodes and edges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import snake_case, snake_plural
from ..operators.schema import EDGES, NODES, TABLE_COLUMNS, conform

# -- DDL and Prisma ------------------------------------------------------------------------

#: The patterns of declarations, the clauses that are no columns, and the column types of Prisma.
CREATE = re.compile(r"\bCREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?[`\"\[]?(?:\w+[`\"\]]?\.[`\"\[]?)?(\w+)[`\"\]]?\s*\(", re.I)
COLUMN = re.compile(r"\s*[`\"\[]?(\w+)[`\"\]]?\s+(\w+(?:\s*\([^)]*\))?)")
TABLE_LEVEL = ("PRIMARY KEY", "UNIQUE", "INDEX", "KEY", "CONSTRAINT", "FOREIGN KEY", "CHECK")
REFERENCES = re.compile(r"\bREFERENCES\s+[`\"\[]?(\w+)[`\"\]]?\s*\(\s*[`\"\[]?(\w+)", re.I)
PRISMA_TYPES = {"String", "Int", "BigInt", "Float", "Decimal", "Boolean", "DateTime", "Json", "Bytes"}


def split_top(body: str) -> list[str]:
    """The parts of a body between commas outside of brackets and quotes."""
    parts, depth, now, quote = [], 0, "", ""
    for c in body:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if c == "," and depth == 0 and not quote:
            parts.append(now)
            now = ""
        else:
            now += c
    return [p for p in [*parts, now] if p.strip()]


def balanced(text: str, at: int) -> str:
    """What stands between the bracket at `at` and its partner; '' if there is none."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == "(") - (text[k] == ")")
        if depth == 0:
            return text[at + 1 : k]
    return ""


def parse_ddl(path: str, source: str) -> list[tuple]:
    source = re.sub(r"--[^\n]*|/\*.*?\*/", " ", source, flags=re.S)
    out = []
    for m in CREATE.finditer(source):
        n = 0
        for part in split_top(balanced(source, m.end() - 1)):
            text = " ".join(part.split())
            if text.upper().startswith(TABLE_LEVEL) or not (c := COLUMN.match(part)):
                continue
            ref = REFERENCES.search(text)
            out.append((m[1], "", "sql", path, c[1], c[2].upper(), "PRIMARY KEY" in text.upper(), "NOT NULL" not in text.upper(), f"{ref[1]}.{ref[2]}" if ref else "", n))
            n += 1
    return out


def parse_prisma(path: str, source: str) -> list[tuple]:
    out = []
    for m in re.finditer(r"^\s*model\s+(\w+)\s*\{(.*?)^\s*\}", source, re.M | re.S):
        mapped = re.search(r'@@map\(\s*"(\w+)"', m[2])
        n = 0
        for line in m[2].splitlines():
            f = re.match(r"\s*(\w+)\s+(\w+)(\[\])?(\?)?(.*)", line)
            if not f or line.strip().startswith(("@@", "//")) or f[2] not in PRISMA_TYPES:
                continue  # other types are relations
            out.append((mapped[1] if mapped else m[1], "", "prisma", path, f[1], f[2], "@id" in f[5], bool(f[4]), "", n))
            n += 1
    return out


def scan_ddl(files: DataFrame) -> DataFrame:
    """TABLE_COLUMNS of the .sql and .prisma files of (file_path, content)."""
    names = [f.name for f in TABLE_COLUMNS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, c in zip(pdf["file_path"], pdf["content"]) for r in (parse_prisma if p.endswith(".prisma") else parse_ddl)(p, c or "")], columns=names)

    wanted = F.col("file_path").endswith(".sql") | F.col("file_path").endswith(".prisma")
    return files.select("file_path", "content").filter(wanted).mapInPandas(run, TABLE_COLUMNS)


# -- ORM classes, with built-in expressions ------------------------------------------------


def _first(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def detect_orm(nodes: DataFrame) -> DataFrame:
    """TABLE_COLUMNS of class and struct nodes that an ORM maps; the first that fits counts."""
    code = F.concat_ws("\n", F.coalesce("raw_code", F.lit("")), F.coalesce("summary_short", F.lit("")))
    c = nodes.filter(F.col("node_type").isin("class", "struct")).select("id", "name", "file_path", code.alias("code"))
    text = F.col("code")
    kind = (
        F.when(text.contains("__tablename__") & text.rlike(r"\b(Base|DeclarativeBase)\b") & text.rlike(r"__tablename__\s*=\s*[\"']\w+[\"']"), "sqlalchemy")
        .when(text.contains("models.Model"), "django")
        .when(text.contains("@Entity"), "typeorm")
        .when(text.contains('gorm:"'), "gorm")
        .when(text.contains("#[derive(Queryable") | text.contains("table_name") | text.contains("#[diesel("), "diesel")
    )
    table = (
        F.when(F.col("kind") == "sqlalchemy", _first(text, r"__tablename__\s*=\s*[\"'](\w+)[\"']"))
        .when(F.col("kind") == "typeorm", F.coalesce(_first(text, r"@Entity\s*\(\s*[\"'](\w+)[\"']"), snake_case(F.col("name"))))
        .when(F.col("kind") == "gorm", snake_plural(F.col("name")))
        .when(F.col("kind") == "diesel", F.coalesce(_first(text, r"#\[diesel\(table_name\s*=\s*(\w+)\)\]"), snake_case(F.col("name"))))
        .otherwise(snake_case(F.col("name")))
    )
    found = c.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("table_name", table)
    split = F.split("code", "\n")
    both = F.arrays_zip(split, F.slice(split, F.lit(2), F.size(split)))  # each line with the next, in one pass over a long text
    lines = found.select("*", F.posexplode(both).alias("ordinal", "__both")).select("*", F.col("__both")["0"].alias("line"), F.col("__both")["1"].alias("next"))
    line = F.col("line")
    # How a line of each ORM declares a column (name, type, arguments).
    sa, dj = r"^\s*(\w+)\s*=\s*Column\s*\(\s*([A-Za-z_][\w.]*)?([^)]*)", r"^\s*(\w+)\s*=\s*models\.(\w+Field|ForeignKey|ManyToManyField|OneToOneField)\s*\(([^)]*)\)"
    ts, go, rs = r"^\s*(\w+)\s*[?!]?\s*:\s*([\w<>\[\]|]+)()", r"^\s*(\w+)\s+(\w+).*?gorm:\"([^\"]*)\"", r"^\s*pub\s+(\w+)\s*:\s*([\w<>]+)()"
    is_ts = (F.col("kind") == "typeorm") & line.rlike(r"@(Column|PrimaryColumn|PrimaryGeneratedColumn)")

    def part(k: int) -> Column:
        pick = lambda p, t=line: F.regexp_extract(t, p, k)
        return F.when(F.col("kind") == "sqlalchemy", pick(sa)).when(F.col("kind") == "django", pick(dj)).when(is_ts, pick(ts, F.col("next"))).when(F.col("kind") == "gorm", pick(go)).when(F.col("kind") == "diesel", pick(rs)).otherwise("")

    cols = lines.select("*", part(1).alias("f"), part(2).alias("t"), part(3).alias("args")).filter("f <> ''")
    args = F.col("args")
    django_fk = F.regexp_extract(args, r"^\s*['\"]?(\w+)['\"]?", 1)
    primary = F.when(F.col("kind") == "sqlalchemy", args.rlike("primary_key ?= ?True")).when(F.col("kind") == "django", (F.col("f") == "id") | args.contains("primary_key=True")).when(F.col("kind") == "typeorm", line.contains("@Primary")).when(F.col("kind") == "gorm", args.contains("primaryKey") | args.contains("primary_key")).otherwise(False)
    nullable = F.when(F.col("kind") == "sqlalchemy", ~args.contains("nullable=False")).when(F.col("kind") == "django", args.contains("null=True") | args.contains("blank=True")).when(F.col("kind") == "typeorm", F.col("next").contains("?")).when(F.col("kind") == "gorm", ~args.contains("not null")).otherwise(True)
    sa_fk = F.concat(F.col("t"), args)
    fk = (
        F.when((F.col("kind") == "sqlalchemy") & sa_fk.contains("ForeignKey"), F.coalesce(_first(line, r"ForeignKey\s*\(\s*[\"'](\w+\.\w+)[\"']"), F.lit("")))
        .when((F.col("kind") == "django") & F.col("t").isin("ForeignKey", "OneToOneField") & ~django_fk.isin("self", ""), F.concat(snake_case(django_fk), F.lit(".id")))
        .otherwise("")
    )
    name = F.when(F.col("kind") == "gorm", F.coalesce(_first(args, r"column:(\w+)"), snake_case(F.col("f")))).otherwise(F.col("f"))
    language = F.when(F.col("kind") == "gorm", "go").when(F.col("kind") == "diesel", "rust").when(F.col("kind") == "typeorm", "typescript").otherwise("python")
    out = cols.select("table_name", F.col("id").alias("source_node_id"), language.alias("language"), "file_path", name.alias("column_name"), F.col("t").alias("column_type"), primary.alias("is_primary"), nullable.alias("is_nullable"), fk.alias("foreign_key"), F.col("ordinal").cast("int").alias("ordinal"))
    bare = found.join(out.select(F.col("source_node_id").alias("id")), "id", "left_anti").select("table_name", F.col("id").alias("source_node_id"), language.alias("language"), "file_path")
    return out.unionByName(conform(bare, TABLE_COLUMNS))


# -- catalogs ------------------------------------------------------------------------------


def connection_kind(url: str) -> str:
    """sqlite, postgresql or mysql; ValueError for anything else."""
    for kind, heads in (("sqlite", ("sqlite:///",)), ("postgresql", ("postgresql://", "postgres://")), ("mysql", ("mysql://", "mysql+pymysql://"))):
        if url.startswith(heads):
            return kind
    raise ValueError(f"unknown database: {url.split('://')[0]}://")


def find_connection(environ: dict[str, str], dotenv: str = "", compose: str = "") -> str | None:
    """DATABASE_URL, DB_URL or DATABASE_URI from the environment, a .env text, or a compose file."""
    for name in ("DATABASE_URL", "DB_URL", "DATABASE_URI"):
        if environ.get(name):
            return environ[name]
    for text in (dotenv, compose):
        m = re.search(r"^\s*-?\s*(?:DATABASE_URL|DB_URL|DATABASE_URI)\s*[=:]\s*[\"']?([^\s\"']+)", text, re.M | re.I)
        if m:
            return m[1]
    return None


def sqlite_catalog(spark: SparkSession, path: str) -> DataFrame:
    """TABLE_COLUMNS of a SQLite file; read by the driver, a catalog is small."""
    import sqlite3

    rows = []
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        for (table,) in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall():
            quoted = '"' + table.replace('"', '""') + '"'
            fks = {r[3]: f"{r[2]}.{r[4] or 'id'}" for r in con.execute(f"PRAGMA foreign_key_list({quoted})")}
            rows += [(table, "", "sql", path, r[1], r[2], bool(r[5]), not r[3], fks.get(r[1], ""), r[0]) for r in con.execute(f"PRAGMA table_info({quoted})")]
    finally:
        con.close()
    return spark.createDataFrame(rows, TABLE_COLUMNS)


def catalog_rows(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """TABLE_COLUMNS from information_schema: columns (table_name, column_name, data_type,
    is_nullable, ordinal_position) and keys (table_name, column_name, constraint_type, ref_table,
    ref_column)."""
    pk = keys.filter("constraint_type = 'PRIMARY KEY'").select("table_name", "column_name", F.lit(True).alias("pk")).distinct()
    fk = keys.filter("constraint_type = 'FOREIGN KEY'").groupBy("table_name", "column_name").agg(F.min(F.concat_ws(".", "ref_table", "ref_column")).alias("fk"))
    on = ["table_name", "column_name"]
    joined = columns.join(pk, on, "left").join(fk, on, "left")
    made = joined.select("table_name", F.lit("").alias("source_node_id"), F.lit("sql").alias("language"), F.lit("").alias("file_path"), "column_name", F.col("data_type").alias("column_type"), F.coalesce("pk", F.lit(False)).alias("is_primary"), (F.col("is_nullable") == "YES").alias("is_nullable"), F.coalesce("fk", F.lit("")).alias("foreign_key"), (F.col("ordinal_position") - 1).alias("ordinal"))
    return conform(made, TABLE_COLUMNS)


def jdbc_catalog(spark: SparkSession, url: str, schema: str, **options: str) -> DataFrame:
    """TABLE_COLUMNS of a PostgreSQL or MySQL schema; needs the driver's jar."""
    kind = connection_kind(url)
    read = lambda q: spark.read.format("jdbc").options(url="jdbc:" + re.sub(r"^(postgres|mysql\+pymysql)://", lambda m: ("postgresql" if m[1] == "postgres" else "mysql") + "://", url), query=q, **options).load()
    columns = read(f"SELECT table_name, column_name, data_type, is_nullable, ordinal_position FROM information_schema.columns WHERE table_schema = '{schema}'")
    if kind == "mysql":
        keys = read(f"SELECT table_name, column_name, CASE WHEN constraint_name = 'PRIMARY' THEN 'PRIMARY KEY' WHEN referenced_table_name IS NOT NULL THEN 'FOREIGN KEY' END AS constraint_type, referenced_table_name AS ref_table, referenced_column_name AS ref_column FROM information_schema.key_column_usage WHERE table_schema = '{schema}'")
    else:
        keys = read(f"SELECT k.table_name, k.column_name, c.constraint_type, u.table_name AS ref_table, u.column_name AS ref_column FROM information_schema.key_column_usage k JOIN information_schema.table_constraints c ON c.constraint_name = k.constraint_name AND c.table_schema = k.table_schema LEFT JOIN information_schema.constraint_column_usage u ON u.constraint_name = k.constraint_name AND c.constraint_type = 'FOREIGN KEY' WHERE k.table_schema = '{schema}'")
    return catalog_rows(columns, keys)


# -- graph ---------------------------------------------------------------------------------


def schema_graph(columns: DataFrame, database: str = "default") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): the database contains tables, these contain columns; a class defines its
    table; a foreign key refers to a column, or to the table where the column isn't known."""
    columns = columns.withColumn("table_id", F.concat(F.lit("table::"), "table_name")).withColumn("column_id", F.concat(F.lit("col::"), "table_name", F.lit("::"), "column_name"))
    tables = columns.groupBy("table_id", "table_name").agg(F.max("file_path").alias("file_path"), F.max("language").alias("language"))
    db = f"db::{database}"
    real = columns.filter("column_name IS NOT NULL")
    note = F.concat(F.lit("Column "), "column_name", F.lit(" ("), F.coalesce("column_type", F.lit("")), F.lit(")"), F.when(F.col("is_primary"), " PK").otherwise(""), F.when(F.col("is_nullable"), "").otherwise(" NOT NULL"))
    spark = columns.sparkSession
    nodes = conform(spark.createDataFrame([(db, database, "database", "database")], "id string, name string, node_type string, category string"), NODES)
    nodes = nodes.unionByName(conform(tables.select(F.col("table_id").alias("id"), F.col("table_name").alias("name"), F.lit("table").alias("node_type"), "file_path", "language", F.lit("database").alias("category")), NODES))
    nodes = nodes.unionByName(conform(real.dropDuplicates(["column_id"]).select(F.col("column_id").alias("id"), F.col("column_name").alias("name"), F.lit("column").alias("node_type"), "file_path", "language", F.col("column_type").alias("signature"), note.alias("summary_short"), F.lit("database").alias("category")), NODES))
    edge = lambda df, s, t, kind: conform(df.select(s.alias("source_id"), t.alias("target_id"), F.lit(kind).alias("edge_type"), F.lit("").alias("context"), F.lit(1.0).alias("weight")).distinct(), EDGES)
    edges = edge(tables, F.lit(db), F.col("table_id"), "contains").union(edge(real, F.col("table_id"), F.col("column_id"), "contains"))
    edges = edges.union(edge(columns.filter("source_node_id <> ''"), F.col("source_node_id"), F.col("table_id"), "defines"))
    fks = real.filter("foreign_key <> ''").select("column_id", F.concat(F.lit("col::"), F.replace("foreign_key", F.lit("."), F.lit("::"))).alias("want"), F.concat(F.lit("table::"), F.substring_index("foreign_key", ".", 1)).alias("want_table"))
    ids = nodes.select(F.col("id").alias("have"))
    wired = fks.join(ids, F.col("want") == F.col("have"), "left").select("column_id", F.coalesce("have", "want_table").alias("target"))
    return nodes, edges.union(edge(wired, F.col("column_id"), F.col("target"), "references"))


# -- queries in code -----------------------------------------------------------------------

NAME = r"([`\"\[]?\w+[`\"\]]?)"
#: Fixed values: (languages, pattern, whether it writes, what its name is: sql, class, object, table,
#: letters that each match holds, in lower case: texts without them are not searched).
TRACES = (
    ("", rf"(?is)\bSELECT\b.{{0,200}}?\bFROM\s+{NAME}", False, "sql", ("select",)),
    ("", rf"(?i)\bINSERT\s+INTO\s+{NAME}", True, "sql", ("nsert",)),
    ("", rf"(?i)\bUPDATE\s+{NAME}\s+SET\b", True, "sql", ("update",)),
    ("", rf"(?i)\bDELETE\s+FROM\s+{NAME}", True, "sql", ("delete",)),
    ("python", r"\b(?:session|db\.session)\.query\(\s*(\w+)", False, "class", ("session.query(",)),
    ("python", r"\bselect\(\s*(\w+)", False, "class", ("select(",)),
    ("python", r"\b(\w+)\.query\s*\.\s*(?:filter|get|all|first|one|count|paginate)\b", False, "class", (".query",)),
    ("python", r"\b(?:session|db\.session)\.(?:add|merge|delete)\(\s*(\w+)", True, "object", ("session.",)),
    ("python", r"\b(?:insert|update|delete)\(\s*(\w+)", True, "class", ("insert(", "update(", "delete(")),
    ("python", r"\b(\w+)\.objects\.(?:filter|get|all|values|values_list|annotate|aggregate|first|last|count|exists|select_related|prefetch_related|exclude|order_by|distinct)\b", False, "class", (".objects.",)),
    ("python", r"\b(\w+)\.objects\.(?:create|update|bulk_create|bulk_update|get_or_create|update_or_create|delete)\b", True, "class", (".objects.",)),
    ("typescript javascript", r"getRepository\(\s*(\w+)\s*\)", False, "class", ("getrepository(",)),
    ("typescript javascript", r"createQueryBuilder\(\s*[\"']?(\w+)[\"']?\s*\)", False, "class", ("createquerybuilder(",)),
    ("typescript javascript", r"getRepository\(\s*(\w+)\s*\)\.(?:save|insert|update|delete|remove)\b", True, "class", ("getrepository(",)),
    ("go", r"\bdb\.(?:First|Find|Take|Scan|Pluck|Count|Row|Rows)\s*\(\s*&\s*(\w+)", False, "object", ("db.",)),
    ("go", r"\bdb\.(?:Create|Save|Updates|Update)\s*\(\s*&\s*(\w+)", True, "object", ("db.",)),
    ("go", r"\bdb(?:\.Unscoped\(\))?\.Delete\s*\(\s*&\s*(\w+)", True, "object", (".delete",)),
    ("rust", r"\b(\w+)::table\s*\.\s*(?:filter|select|load|first|get_result|count)\b", False, "table", ("::table",)),
    ("rust", r"diesel::(?:insert_into|update|delete)\(\s*(\w+)::table\s*\)", True, "table", ("diesel::",)),
)


def table_refs(code: DataFrame, id_col: str = "id", text_col: str = "raw_code", language_col: str = "language") -> DataFrame:
    """(id, name, kind, edge_type): what each text says it reads (queries) or writes (writes_to)."""
    hits = []
    for languages, pattern, writes, kind, needs in TRACES:
        may = reduce(lambda a, b: a | b, [F.col("__low").contains(n) for n in needs])
        if languages:
            may = F.col("__language").isin(*languages.split()) & may
        found = F.when(may, F.regexp_extract_all("__text", F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
        hits.append(_hits(found, kind, writes))
    text = F.coalesce(text_col, F.lit(""))
    code = code.select(F.col(id_col).alias("id"), text.alias("__text"), F.lower(text).alias("__low"), F.col(language_col).alias("__language"))
    return code.select("id", F.explode(F.array_distinct(F.flatten(F.array(*hits)))).alias("x")).select("id", "x.name", "x.kind", "x.edge_type")


def _hits(found: Column, kind: str, writes: bool) -> Column:
    return F.transform(found, lambda n: F.struct(F.regexp_replace(n, "[`\"\\[\\]']", "").alias("name"), F.lit(kind).alias("kind"), F.lit("writes_to" if writes else "queries").alias("edge_type")))


def trace_queries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges from functions and methods to the tables that their code reads or writes. Classes
    stand for the tables that they define; objects for the class of their name."""
    code = nodes.filter(F.col("node_type").isin("function", "method"))
    refs = table_refs(code)
    tables = nodes.filter("node_type = 'table'").select(F.col("id").alias("target_id"), F.lower("name").alias("key"), F.lit("table").alias("by"))
    classes = nodes.filter(F.col("node_type").isin("class", "struct")).select(F.col("id").alias("__class"), F.col("name").alias("key"))
    defined = edges.filter("edge_type = 'defines'").select(F.col("source_id").alias("__class"), "target_id")
    by_class = classes.join(defined, "__class").select("target_id", "key", F.lit("class").alias("by"))
    capital = F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    keyed = refs.withColumn("by", F.when(F.col("kind").isin("sql", "table"), "table").otherwise("class")).withColumn("key", F.explode(F.when(F.col("kind").isin("sql", "table"), F.array(F.lower("name"))).when(F.col("kind") == "object", F.array_distinct(F.array("name", capital))).otherwise(F.array("name"))))
    found = keyed.join(tables.union(by_class), ["by", "key"])
    return conform(found.groupBy(F.col("id").alias("source_id"), "target_id", "edge_type").agg(F.min("name").alias("context")).withColumn("weight", F.lit(1.0)), EDGES)


def ordered_columns(columns: DataFrame) -> DataFrame:
    """(table_name, columns): the column names of each table in their order."""
    w = Window.partitionBy("table_name", "column_name").orderBy("ordinal")
    one = columns.filter("column_name IS NOT NULL").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return one.groupBy("table_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "column_name"))), lambda x: x["column_name"]), ",").alias("columns"))
