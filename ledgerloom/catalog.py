"""The typed entity catalogue, and what the fixture tables stand for in it.

An entity is a list of typed fields with choices and defaults; its schema is a StructType whose metadata carry the rest.
A binding is portable SQL over the fixture tables, run by Spark for the queries and by DuckDB for their equivalents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.shipping import ship, small_batches

KINDS = {"text": T.StringType(), "longtext": T.StringType(), "int": T.LongType(), "money": T.LongType(), "percent": T.IntegerType(), "date": T.StringType(), "datetime": T.StringType(), "choice": T.StringType(), "project": T.LongType(), "real": T.DoubleType()}


@dataclass(frozen=True)
class FieldSpec:
    name: str
    kind: str = "text"
    required: bool = False
    choices: tuple[str, ...] = ()
    default: str | int | None = None
    system: bool = False

    def struct(self) -> T.StructField:
        meta = {"kind": self.kind, "required": self.required, "choices": list(self.choices), "default": self.default, "system": self.system}
        return T.StructField(self.name, KINDS[self.kind], True, meta)


@dataclass(frozen=True)
class EntitySpec:
    name: str
    fields: tuple[FieldSpec, ...]
    title: str
    date: str | None = None
    search: tuple[str, ...] = ()
    #: (column, descending or the list of values in order)
    order: tuple[tuple[str, bool | tuple[str, ...]], ...] = field(default=(("id", True),))

    def schema(self) -> T.StructType:
        own = [T.StructField("id", T.LongType(), False), *(f.struct() for f in self.fields), T.StructField("created_at", T.StringType()), T.StructField("updated_at", T.StringType())]
        return T.StructType(own)

    def by_name(self, name: str) -> FieldSpec | None:
        return next((f for f in self.fields if f.name == name), None)


#: States and kinds, in their order of display.
PROJECT_STATUS = ("active", "tender", "on_hold", "done", "closed")
TASK_STATUS = ("doing", "todo", "waiting", "done", "cancelled")
PRIORITY = ("urgent", "high", "medium", "low")
INVOICE_STATUS = ("draft", "submitted", "reviewing", "approved", "paid", "rejected")
F_ = FieldSpec

CATALOG: dict[str, EntitySpec] = {
    e.name: e
    for e in (
        EntitySpec("projects", (F_("name", required=True), F_("code"), F_("role", "choice"), F_("employer"), F_("contractor"), F_("consultant"), F_("location"), F_("contract_amount", "money"), F_("start_date", "date"), F_("end_date", "date"), F_("progress", "percent", default=0), F_("status", "choice", choices=PROJECT_STATUS, default="active"), F_("notes", "longtext")), "name", "start_date", ("name", "code", "employer", "contractor", "location", "notes"), (("status", PROJECT_STATUS), ("id", True))),
        EntitySpec("tasks", (F_("title", required=True), F_("description", "longtext"), F_("project_id", "project"), F_("category", "choice"), F_("priority", "choice", choices=PRIORITY, default="medium"), F_("status", "choice", choices=TASK_STATUS, default="todo"), F_("due_date", "date"), F_("due_time"), F_("remind_at", "datetime"), F_("reminded", "int", system=True), F_("completed_at", "datetime", system=True)), "title", "due_date", ("title", "description"), (("status", TASK_STATUS), ("due_date", False), ("priority", PRIORITY), ("id", False))),
        EntitySpec("daily_reports", (F_("project_id", "project", True), F_("report_date", "date", True), F_("weather"), F_("temperature"), F_("manpower", "longtext"), F_("equipment", "longtext"), F_("materials", "longtext"), F_("work_done", "longtext", True), F_("issues", "longtext"), F_("instructions", "longtext"), F_("notes", "longtext")), "report_date", "report_date", ("work_done", "issues", "materials", "notes"), (("report_date", True), ("id", True))),
        EntitySpec("invoices", (F_("project_id", "project", True), F_("number", required=True), F_("kind", "choice"), F_("period_start", "date"), F_("period_end", "date"), F_("gross_amount", "money", True), F_("deductions", "money", default=0), F_("net_amount", "money"), F_("status", "choice", choices=INVOICE_STATUS, default="draft"), F_("submit_date", "date"), F_("approved_amount", "money"), F_("paid_amount", "money", default=0), F_("paid_date", "date"), F_("notes", "longtext")), "number", "submit_date", ("number", "notes")),
        EntitySpec("transactions", (F_("tx_date", "date", True), F_("kind", "choice", True, ("income", "expense")), F_("amount", "money", True), F_("project_id", "project"), F_("category"), F_("counterparty"), F_("description", "longtext", True)), "description", "tx_date", ("description", "counterparty", "category"), (("tx_date", True), ("id", True))),
        EntitySpec("contacts", (F_("name", required=True), F_("company"), F_("role"), F_("phone"), F_("email"), F_("project_id", "project"), F_("notes", "longtext")), "name", None, ("name", "company", "role", "phone", "notes"), (("name", False),)),
        EntitySpec("notes", (F_("title", required=True), F_("content", "longtext"), F_("tags"), F_("project_id", "project")), "title", None, ("title", "content", "tags")),
    )
}

#: Fixture tables as entities, in SQL that Spark and DuckDB both run.
BINDINGS: dict[str, str] = {
    "projects": """SELECT c_custkey AS id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'active' WHEN 'MACHINERY' THEN 'tender'
        WHEN 'FURNITURE' THEN 'on_hold' WHEN 'HOUSEHOLD' THEN 'done' ELSE 'closed' END AS status,
        CAST(round(c_acctbal * 1000) AS BIGINT) AS contract_amount FROM customer""",
    "tasks": """SELECT o_orderkey AS id, o_custkey AS project_id, concat('Task ', CAST(o_orderkey AS VARCHAR(20)), ' ', lower(o_orderpriority)) AS title,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS due_date,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE NULL END AS priority,
        CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'todo' ELSE 'doing' END AS status FROM orders""",
    "invoices": """SELECT o.o_orderkey AS id, o.o_custkey AS project_id, concat('INV-', CAST(o.o_orderkey AS VARCHAR(20))) AS number,
        l.gross AS gross_amount, l.ded AS deductions, CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE l.gross - l.ded END AS net_amount,
        CASE WHEN o.o_orderkey % 11 = 0 THEN 'draft' WHEN o.o_orderstatus = 'F' THEN 'paid' WHEN o.o_orderstatus = 'O' THEN 'submitted' ELSE 'approved' END AS status,
        CAST(o.o_orderdate AS DATE) AS submit_date,
        CASE WHEN o.o_orderkey % 7 = 0 THEN 0 WHEN l.flags > 1 THEN NULL ELSE l.gross - l.ded - l.gross % 1000 END AS approved_amount,
        CASE WHEN o.o_orderstatus = 'F' THEN l.gross - l.ded WHEN o.o_orderkey % 3 = 0 THEN NULL ELSE 0 END AS paid_amount
        FROM orders o JOIN (SELECT l_orderkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS gross,
          CAST(sum(CAST(round(l_extendedprice * l_discount * 100) AS BIGINT)) AS BIGINT) AS ded, count(DISTINCT l_linestatus) AS flags
          FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "transactions": """SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS project_id, CASE WHEN l_returnflag = 'R' THEN 'expense' ELSE 'income' END AS kind,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS amount, CAST(l_shipdate AS DATE) AS tx_date, nullif(p_type, 'PROMO') AS category,
        concat(p_name, ' x', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR(20))) AS description
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "daily_reports": """SELECT event_id AS id, user_id AS project_id, CAST(ts AS DATE) AS report_date, event_type AS work_done, CAST(round(value * 100) AS BIGINT) AS amount FROM events""",
    "letters": """SELECT conv_id * 100 + turn AS id, conv_id AS project_id, turn, role, text,
        CASE WHEN turn > 0 THEN conv_id * 100 + turn - 1 - CASE WHEN turn % 4 = 3 THEN 50 ELSE 0 END ELSE NULL END AS ref_no,
        CAST(DATE '2024-01-01' + CAST(conv_id % 20 AS INT) + CAST(turn AS INT) AS DATE) AS letter_date FROM conversations""",
    "trades": """SELECT l_orderkey * 10 + l_linenumber AS id, p_brand AS symbol, CASE WHEN l_linestatus = 'O' THEN 'long' ELSE 'short' END AS side,
        p_retailprice AS entry_price, l_quantity AS margin, 1 + l_linenumber AS leverage, l_extendedprice / l_quantity AS price1, l_tax AS entry_fee,
        CASE WHEN l_linenumber = 5 THEN 0.0 ELSE p_retailprice * 0.9 END AS sl, p_retailprice * 1.3 AS tp,
        CASE WHEN l_shipdate >= o_orderdate THEN CAST(o_orderdate AS DATE) ELSE CAST(CAST(l_shipdate AS DATE) - CAST(1 + l_linenumber AS INT) AS DATE) END AS opened_at, CAST(l_shipdate AS DATE) AS at1,
        CASE WHEN l_linenumber % 3 = 0 THEN 60.0 WHEN l_linenumber = 7 THEN 50.0 ELSE 100.0 END AS pct1, CASE WHEN l_linenumber % 3 = 0 THEN 40.0 END AS pct2,
        l_extendedprice / l_quantity * 1.05 AS price2, CAST(CAST(l_shipdate AS DATE) + 2 AS DATE) AS at2, l_tax / 2 AS fee2,
        nullif(p_type, 'PROMO') AS strategy, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_returnflag END AS exit_type,
        CASE WHEN l_linenumber = 4 THEN 'late، early' WHEN l_linenumber = 1 THEN 'late' END AS mistake, o_orderpriority AS mood, o_orderstatus AS exchange
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "transfers": """SELECT s_suppkey AS id, CAST(round(s_acctbal * 100) AS BIGINT) AS amount, CAST(DATE '1995-01-01' + CAST(s_suppkey % 2000 AS INT) AS DATE) AS day FROM supplier""",
}


def with_entities(sql: str, uses: tuple[str, ...]) -> str:
    if not uses:
        return sql
    views = ", ".join(f"{n} AS ({BINDINGS[n]})" for n in uses)
    return f"WITH {views}, {sql.strip()[5:]}" if sql.strip()[:5].upper() == "WITH " else f"WITH {views} {sql}"


class Bound:
    """The fixture tables of a folder, and the entities bound to them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        ship(spark)
        small_batches(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def entity(self, name: str) -> DataFrame:
        sql = BINDINGS[name].replace("VARCHAR(20)", "STRING")
        tables = {t: self.table(t) for t in ("customer", "orders", "lineitem", "part", "events", "conversations", "supplier") if t in sql}
        for t, df in tables.items():
            sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(sql, **tables)
