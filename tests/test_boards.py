"""Dashboard, project sheets and finance on small tables: nulls, ties, unknown states, empty tables."""

from ledgerloom.plans import boards

AS_OF = "2024-05-10"
SCHEMAS = {
    "projects": "id long, name string, status string, contract_amount long, start_date date, end_date date, progress int",
    "tasks": "id long, project_id long, title string, status string, priority string, due_date date",
    "reports": "id long, project_id long, report_date date",
    "invoices": "id long, project_id long, number string, status string, net_amount long, approved_amount long, paid_amount long, submit_date date",
    "transactions": "id long, project_id long, kind string, category string, amount long, tx_date date",
}
ROWS = {
    "projects": [(1, "A", "active", 1000, "2024-01-01", "2024-12-31", 40), (2, "A", "done", 0, None, None, None), (3, None, "tender", None, "2024-05-10", "2024-05-10", 0)],
    "tasks": [(1, 1, "late", "todo", "low", "2024-05-01"), (2, 1, "now", "doing", "urgent", "2024-05-10"), (3, None, "soon", "waiting", None, "2024-05-17"), (4, 1, "far", "todo", "high", "2024-05-18"),
              (5, 9, "undated", "todo", "high", None), (6, 1, "gone", "done", "high", "2024-05-01"), (7, 1, "odd", None, "low", None), (8, 1, "quiet", "todo", "low", None)],
    "reports": [(1, 1, "2024-05-01"), (2, 1, "2024-05-01"), (3, 1, None), (4, None, "2024-05-09")],
    "invoices": [(1, 1, "I1", "submitted", 500, 0, None, "2024-04-10"), (2, 1, "I2", "paid", 100, 100, 100, "2024-04-01"), (3, None, "I3", "partial", None, 300, 100, None), (4, 1, "I4", "draft", 7, None, 0, None)],
    "transactions": [(1, 1, "income", "x", 100, "2024-05-02"), (2, 1, "expense", None, 30, "2024-05-10"), (3, None, "expense", "x", 5, "2024-05-11"), (4, 2, "income", None, 7, "2024-04-30")],
}


def tables(spark, empty=()):
    made = {}
    for name, schema in SCHEMAS.items():
        loose = ", ".join(c.replace(" date", " string") for c in schema.split(", "))
        df = spark.createDataFrame([] if name in empty else ROWS[name], loose)
        made[name] = df.selectExpr(*(f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in schema.split(", ")))
    return made


def board(spark, empty=()):
    t = tables(spark, empty)
    return boards.dashboard(t["projects"], t["tasks"], t["reports"], t["invoices"], t["transactions"], AS_OF).collect()


def test_dashboard(spark):
    rows = board(spark)
    by = {(r.section, r.id): r for r in rows}
    assert len(rows) == 4 + 2 + 2 + 2
    assert [by[k].title for k in (("overdue", 1), ("today", 2), ("upcoming", 3), ("undated", 5))] == ["late", "now", "soon", "undated"]
    assert by["upcoming", 3].days == 7 and by["upcoming", 3].project_name is None and by["undated", 5].project_name is None
    assert by["overdue", 1].days == -9 and by["overdue", 1].project_name == "A" and by["today", 2].rank == 0
    assert (by["project", 1].open_tasks, by["project", 1].day, by["project", 1].days) == (4, "2024-05-01", 235)
    assert by["project", 3].open_tasks == 0 and by["project", 3].day is None
    assert (by["invoice", 1].amount, by["invoice", 1].days) == (500, 30) and (by["invoice", 3].amount, by["invoice", 3].days) == (200, None)
    assert {r.title: r.amount for r in rows if r.section == "month"} == {"income": 100, "expense": 30}
    # whatever is missing, the month's two rows stay
    assert {(r.section, r.title, r.amount) for r in board(spark, tuple(SCHEMAS))} == {("month", "income", 0), ("month", "expense", 0)}


def test_sheet(spark):
    t = tables(spark)
    rows = {r.project_id: r for r in boards.sheet(*t.values(), AS_OF).collect()}
    a = rows[1]
    assert (a.tasks, a.tasks_todo, a.tasks_doing, a.tasks_done, a.tasks_waiting, a.tasks_other) == (6, 3, 1, 1, 0, 1)
    # doing first, then by day with none last, then by priority and id; a task without a state is open and last
    assert a.open_tasks == [2, 1, 4, 8, 7] and a.recent_reports == [2, 1, 3]
    assert (a.time_progress, a.progress, a.days_left, a.net, a.billed) == (36, 40, 235, 607, 60.7)
    assert (a.income, a.expense) == (100, 30)
    assert rows[2].billed is None and rows[2].open_tasks == [] and rows[2].income == 7
    assert rows[3].time_progress is None and rows[3].days_left == 0 and rows[3].billed is None
    two = {r.project_id: r for r in boards.sheet(*t.values(), AS_OF, shown=2, recent=1).collect()}
    assert two[1].open_tasks == [2, 1] and two[1].recent_reports == [2]
    bare = tables(spark)["projects"].drop("start_date", "end_date", "progress")
    assert {r.time_progress for r in boards.sheet(bare, *list(t.values())[1:], AS_OF).collect()} == {None}
    assert boards.sheet(*tables(spark, ("projects",)).values(), AS_OF).count() == 0


def test_finance(spark):
    t = tables(spark)
    get = lambda **how: {(r.section, r.kind, r.label, r.project_id): (r.total, r.n) for r in boards.finance(t["transactions"], t["projects"], t["invoices"], **how).collect()}
    rows = get()
    assert rows["balance", None, None, None] == (72, 4) and rows["total", "income", None, None] == (107, 2) and rows["total", "expense", None, None] == (35, 2)
    assert rows["category", "expense", None, None] == (30, 1) and rows["category", "expense", "x", None] == (5, 1)
    assert rows["project", "expense", None, None] == (5, 1) and rows["project", "income", "A", 1] == (100, 1) and rows["project", "income", "A", 2] == (7, 1)
    assert rows["month", "income", "1403/02", None] == (107, 2) and rows["receivable", None, None, None] == (200, 2)
    one = get(project=1, start="2024-05-03")
    assert one["balance", None, None, None] == (-30, 1) and one["receivable", None, None, None] == (0, 1)
    none = tables(spark, ("transactions", "invoices"))
    assert [(r.section, r.total, r.n) for r in boards.finance(none["transactions"], none["projects"], none["invoices"]).collect()] == [("receivable", 0, 0)]
